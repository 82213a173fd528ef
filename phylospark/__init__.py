"""PhyloSpark: lineage simulation, reconstruction and tree scoring as Spark plans."""

__version__ = "0.1.0"

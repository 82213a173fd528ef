"""The locus table: one row for each position of a genome, with optional overrides of the model's general values.

Its size is the genome's length, so it is collected into literals or broadcast by later steps; ``MAX_LOCI`` states the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospark.sources.config import Model
from phylospark.sources.profiles import in_order

MAX_LOCI = 100_000

# Keys of a parameter text, and the columns they fill.
KEYS = {
    "EVENT_PROB": "event_prob", "DUPLICATION_PROB": "duplication_prob", "DUPLICATION_MULTIPLICITY": "duplication_multiplicity", "LOSS_PROB": "loss_prob", "SINGLE_OR_MULTIPLE_EVENT_PROB": "multiple_prob", "TELOMERIC_INSTABILITY": "telomeric_instability",
}


def parameters(text: Column) -> Column:
    """K=V;K=V as a map of doubles: parts without "=" are skipped, and of a key that repeats the last value counts."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.split(p, "=")[0].alias("key"), F.split(p, "=")[1].cast("double").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def with_defaults(rows: DataFrame, text: str = "Parameters") -> DataFrame:
    """Columns of a parsed parameter text: cn 2, weight 0 and crucial 0 where absent, overrides null."""
    m = parameters(F.coalesce(F.col(text), F.lit("")))
    get = lambda key: F.try_element_at(m, F.lit(key))
    return rows.withColumns({
        "cn": F.coalesce(get("CN").cast("int"), F.lit(2)), **{column: get(key) for key, column in KEYS.items()}, "crucial": F.coalesce(get("CRUCIAL"), F.lit(0.0)), "fitness_weight": F.coalesce(get("FITNESS_WEIGHT"), F.lit(0.0)),
    })


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of ChromosomeNumber, Start, End, Parameters; the position is the row's place in them, in the order of their names. Start and End
    are not used."""
    rows = in_order(spark.read.csv(path, header=True, schema="ChromosomeNumber int, Start long, End long, Parameters string"), "pos")
    rows = rows.withColumn("pos", F.col("pos").cast("int"))
    return with_defaults(rows).withColumn("chromosome", F.coalesce("ChromosomeNumber", F.lit(1))).drop("Start", "End", "Parameters", "ChromosomeNumber")


def constant_loci(spark: SparkSession, model: Model) -> DataFrame:
    """The loci of a model without a table: all alike."""
    rows = spark.range(model.genome_length).select(F.col("id").cast("int").alias("pos"), F.lit(1).alias("chromosome"))
    return with_defaults(rows.withColumn("Parameters", F.lit(f"CN={model.initial_copies}"))).drop("Parameters")


def telomere_factor(loci: DataFrame, share: float, general: float) -> DataFrame:
    """Adds telomere: the general value on the first and last loci of each chromosome, as many as share makes, unless overridden."""
    ends = Window.partitionBy("chromosome")
    place = F.row_number().over(ends.orderBy("pos"))
    n = F.count(F.lit(1)).over(ends)
    size = F.floor(n * F.lit(share))
    near = F.when((place <= size) | (place > n - size), F.lit(general)).otherwise(F.lit(0.0))
    return loci.withColumn("telomere", F.coalesce("telomeric_instability", near))


def resolve(loci: DataFrame, model: Model) -> DataFrame:
    """Effective values: the locus' own where given, the model's otherwise; ``p_event`` is what the simulation draws with."""
    general = {"event_prob": model.event_prob, "duplication_prob": model.duplication_prob, "duplication_multiplicity": model.duplication_multiplicity, "loss_prob": model.loss_prob, "multiple_prob": model.multiple_prob}
    out = loci.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in general.items()})
    if not model.telomeres:
        return out.withColumn("telomere", F.lit(0.0)).withColumn("p_event", F.col("event_prob"))
    out = telomere_factor(out, model.telomere_share, model.telomere_instability)
    return out.withColumn("p_event", F.least(F.lit(1.0), F.col("event_prob") + F.col("telomere")))


def write_resolved(loci: DataFrame, path: str, telomeres: bool) -> None:
    """The effective parameters as a CSV with a header, one row a locus in order."""
    columns = {
        "CN": "cn", "Chromosome": "chromosome", "GENERAL_EVENT_PROB": "event_prob", "GENERAL_DUPLICATION_PROB": "duplication_prob", "GENERAL_DUPLICATION_MULTIPLICITY": "duplication_multiplicity", "GENERAL_LOSS_PROB": "loss_prob",
        "GENERAL_SINGLE_OR_MULTIPLE_EVENT_PROB": "multiple_prob", "CRUCIAL_FOR_SURVIVAL": "crucial", "FITNESS_WEIGHT": "fitness_weight", **({"TELOMERIC_INSTABILITY": "telomere"} if telomeres else {}),
    }
    loci.coalesce(1).orderBy("pos").select(*(F.col(c).alias(name) for name, c in columns.items())).write.mode("overwrite").csv(path, header=True)


def write_bed_like(loci: DataFrame, path: str) -> None:
    """ChromosomeNumber, Start, End, Parameters with CN alone, in order."""
    rows = loci.coalesce(1).orderBy("pos").select(F.lit(1).alias("ChromosomeNumber"), F.lit(0).alias("Start"), F.lit(0).alias("End"), F.concat(F.lit("CN="), F.col("cn")).alias("Parameters"))
    rows.write.mode("overwrite").csv(path, header=True)

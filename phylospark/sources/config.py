"""Simulation parameters: a JSON object, validated into a Model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The names of configuration entries and of offspring models.
REQUIRED = (
    "NUMBER_OF_GENERATIONS", "OFFSPRING_MODEL", "OFFSPRING_PARAMETER", "GENERAL_EVENT_PROB", "GENERAL_DUPLICATION_PROB", "GENERAL_DUPLICATION_MULTIPLICITY", "GENERAL_LOSS_PROB", "GENERAL_SINGLE_OR_MULTIPLE_EVENT_PROB",
)
TELOMERE = ("GENERAL_TELOMERIC_INSTABILITY", "GENERAL_TELOMERIC_PERCENTAGE")
OPTIONAL = ("genome_length", "initial_copies", "REPRESENTATION_TYPE", "MODEL_TELOMERIC_REGIONS", "MODEL_CRUCIAL_FOR_SURVIVAL")
OFFSPRING_MODELS = ("constant", "uniform_range", "poisson", "fitness")


def is_true(value: Column) -> Column:
    """A flag given as a text, in any case."""
    return F.lower(value.cast("string")) == "true"


@dataclass(frozen=True)
class Model:
    generations: int
    offspring: str
    offspring_parameter: str
    event_prob: float
    duplication_prob: float
    duplication_multiplicity: float
    loss_prob: float
    multiple_prob: float
    genome_length: int | None = None
    initial_copies: int | None = None
    representative: bool = True
    telomeres: bool = False
    telomere_share: float = 0.0
    telomere_instability: float = 0.0
    crucial: bool = False
    #: Options beyond the defaults of the model: each changes how an event is drawn or applied.
    locus_overrides: bool = False  # a locus' own probabilities of duplication, extent and copies draw
    crucial_everywhere: bool = False  # each locus that an event brings to 0 is judged by its own flag, not by that of the event's first
    absorbing_zero: bool = False  # a lost locus stays lost
    clip_chromosomes: bool = False  # an event ends with the chromosome that it starts on

    def __post_init__(self):
        if self.offspring not in OFFSPRING_MODELS:
            raise ValueError(f"unsupported OFFSPRING_MODEL: {self.offspring}")


def model_of(values: dict[str, object]) -> Model:
    """A Model from the JSON object's entries; missing required ones raise an error."""
    missing = [k for k in REQUIRED if values.get(k) is None]
    flag = lambda k: str(values.get(k)).lower() == "true"
    if flag("MODEL_TELOMERIC_REGIONS"):
        missing += [k for k in TELOMERE if values.get(k) is None]
    if missing:
        raise ValueError(f"missing in the configuration: {', '.join(missing)}")
    kind = values.get("REPRESENTATION_TYPE") or "representative"
    if kind not in ("full", "representative"):
        raise ValueError("REPRESENTATION_TYPE must be 'full' or 'representative'")
    number = lambda k: float(values[k]) if values.get(k) is not None else 0.0
    whole = lambda k: int(values[k]) if values.get(k) is not None else None
    return Model(
        int(values["NUMBER_OF_GENERATIONS"]), str(values["OFFSPRING_MODEL"]), str(values["OFFSPRING_PARAMETER"]), *(number(k) for k in REQUIRED[3:]), whole("genome_length"), whole("initial_copies"), kind == "representative",
        flag("MODEL_TELOMERIC_REGIONS"), number(TELOMERE[1]), number(TELOMERE[0]), flag("MODEL_CRUCIAL_FOR_SURVIVAL"),
    )


def read_model(spark: SparkSession, path: str) -> Model:
    """One JSON object that may span lines; all entries are read as texts and cast here."""
    schema = ", ".join(f"`{k}` string" for k in (*REQUIRED, *TELOMERE, *OPTIONAL))
    return model_of(spark.read.schema(schema).json(path, multiLine=True).first().asDict())

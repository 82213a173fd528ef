"""The corpus pipeline: documents through five corpus operators, one written table per stage.

quality -> near_duplicates -> decontamination -> mixing -> sharding. Every stage takes all that its predecessor kept. All but the
last return the columns of documents; mixing repeats a row as often as the mix takes it, sharding adds shard (no slot; op5 numbers rows).

Defined cases, for every stage: an empty table gives an empty one; columns beyond doc_id, text and source are carried, whatever their
names; a null or empty text is scored, has fingerprint zero, no window and no words; a null doc_id is a key like any other; texts are worked
through whole, however long; of rows that are alike the second stage keeps one, the others treat each alike. Each function states more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.llm import _shared, decontamination, mixing, quality, sharding, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; repeated rows score alike, an empty or null text scores as one without differences."""
    score = quality.scorer(quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text")) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of linked fingerprints: the one with the smallest doc_id, once. Null and empty texts are one
    fingerprint, so one of them stays; a null doc_id stays only where its component has no other; rows of one doc_id are told apart by
    fingerprint, and of those alike in both the one with the least hash of all columns stays."""
    return simhash.keep_one(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. Rows alike in doc_id and text go or stay together; null texts stay."""
    row = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))
    index = decontamination.build_index(docs.select(row.alias("row"), "text"), "row", "text")
    found = decontamination.find_items(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    hit = _shared.stage(found.where(decontamination.n_hit() > 0).select("key").distinct(), "hit")
    return docs.join(hit, row == hit["key"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a document without words is never taken, so it leaves here.

    Null sources are one source, the last; null keys hash as the empty text. Rows that share key and source are split by their texts at
    a boundary, wholly alike ones by a number, for which the documents are written once more."""
    columns, number = docs.columns, _shared.fresh(docs, "number")
    _, budget = mixing.plan_mix(docs, "doc_id", "text", "source")
    if budget.where("alike >= 0").isEmpty():
        docs = docs.withColumn(number, F.lit(0).cast("long"))
    else:
        docs = _shared.stage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        _, budget = mixing.plan_mix(docs, "doc_id", "text", "source", row=number)
    plan = _shared.fresh(docs, "plan")
    budget = budget.select(F.struct("*").alias(plan))
    rows = docs.join(F.broadcast(budget), mixing.source_key(F.col("source")) == F.col(f"{plan}.skey"))  # a row per source, at most max_sources
    text = F.col("text")
    taken = mixing.times_taken(mixing.key_hash(F.col("doc_id")), mixing.key_hash(text), F.col(number), lambda c: F.col(f"{plan}.{c}"))
    taken = F.when(mixing.word_count(text) > 0, taken).otherwise(0)
    return rows.withColumn(plan, F.explode(F.array_repeat(F.lit(0), taken.cast("int")))).select(*(F.col(f"`{c}`") for c in columns))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: int = 16) -> DataFrame:
    """Every row with its shard by jump hash of doc_id: rows of one doc_id share a shard, a null one is a key of its own. Where the
    documents have a column shard, the new one is named __shard."""
    name = _shared.fresh(docs, "shard") if "shard" in docs.columns else "shard"
    return docs.withColumn(name, sharding.shard_of(F.col("doc_id"), shards))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The first two stages have no SQL: a trained classifier, and hashes that DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _shared.stage(docs, name)
    return docs

"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash of its key. The words a source still owes to the mix are taken from its documents in hash
order, but nothing is sorted: words are summed by source and by the top 12 bits of the hash, the bucket in which the running sum
passes the budget is found, and only that bucket is split by the next 12 bits, until one hash is left. Documents up to that hash
are taken. Budgets of one source are nested: a smaller one takes a subset of a larger one's documents.

Where several rows share the hash at the boundary (rows of one key), they are split in the same way by a hash of the text, and rows
alike in both by a number each got when the slim rows were written. So a key that holds a third of all rows doesn't move the sum
from its target; which of wholly alike rows are taken makes no difference to the result, only how many.

A source whose target is above its size is taken whole as often as the target holds it, at most ``max_repeats`` times, and a
threshold covers the rest. The document at the boundary is taken if that brings the sum nearer to the target.

Defined cases: a null text has no words; null sources form one source, the last; a null key hashes as the empty text; documents without words are
never taken; an empty table gives an empty result. Columns beyond those
named are ignored by ``plan_mix``. All of this is DataFrame work; what reaches the driver is one row per source, and more than
``max_sources`` sources raise an error.

``OP7_SQL`` decides rows of one key and source alike, so it is the same rule wherever these differ in key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.llm._shared import stage

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 12
BUDGET_TYPE = "skey string, source_size long, target double, repeats long, threshold long, tie long, tie_threshold long, alike long, alike_threshold long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, as a long; of a text too."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A text that keeps null apart from every source and sorts it last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sizes: list[tuple[str, int]], weights: tuple[float, ...], share: float, max_repeats: float) -> dict[str, float]:
    """Water filling: sources in order take the weights in turn; a target above its limit stops there and the rest is shared anew."""
    weight = {k: weights[i % len(weights)] for i, (k, _) in enumerate(sizes)}
    limit = {k: max_repeats * n for k, n in sizes}
    left, total, found = list(weight), share * sum(n for _, n in sizes), {}
    while left:
        level = (total - sum(found.values())) / sum(weight[k] for k in left)
        full = [k for k in left if level * weight[k] >= limit[k]]
        if not full:
            return found | {k: level * weight[k] for k in left}
        found |= {k: float(limit[k]) for k in full}
        left = [k for k in left if k not in found]
    return found


def thresholds(rows: DataFrame, budgets: dict[str, float], ties: dict[str, tuple[int, float]] | None = None) -> dict[str, int]:
    """The hash up to which each source's rows (skey, size, h) are taken to come nearest to its budget. With ties, a source with several
    rows of the hash at the boundary gets an entry there, the hash and what is left of the budget, and ends before that hash."""
    spark = rows.sparkSession
    state, done = {k: (0, 0, b) for k, b in budgets.items() if b > 0}, {k: -1 for k, b in budgets.items() if b <= 0}
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        if not state:
            break
        near = spark.createDataFrame([(k, p, int(below), float(b)) for k, (p, below, b) in state.items()], "skey string, prefix long, below long, budget double")
        inside = rows.join(F.broadcast(near), "skey").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("m"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n"), F.first("below").alias("below"), F.first("budget").alias("budget"))
        order = Window.partitionBy("skey").orderBy("bucket")
        sums = sums.withColumn("end", F.col("below") + F.sum("m").over(order))
        first = sums.where("end > budget").groupBy("skey").agg(F.min_by(F.struct("bucket", "m", "end", "lo", "hi", "n"), "bucket").alias("b"))
        found = {r["skey"]: r["b"] for r in first.collect()}
        for k, (_, _, budget) in list(state.items()):
            b = found.get(k)
            if b is None:  # the whole source is within its budget
                done[k] = (1 << HASH_BITS) - 1
                del state[k]
            elif b["lo"] == b["hi"] and b["n"] > 1 and ties is not None:
                done[k], ties[k] = b["hi"] - 1, (b["hi"], budget - (b["end"] - b["m"]))
                del state[k]
            elif b["lo"] == b["hi"]:
                done[k] = b["hi"] if 2 * (budget - (b["end"] - b["m"])) >= b["m"] else b["hi"] - 1
                del state[k]
            else:
                state[k] = (b["bucket"], b["end"] - b["m"], budget)
    return done


def plan_mix(docs: DataFrame, key: str, text: str, source: str, weights=(3, 1, 2), share: float = 1.5, max_repeats: int = 2, max_sources: int = 100_000, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The slim rows (key, skey, size, h, h2, n), staged, and the budget table by source; ``times_taken`` joins them. row: a column that
    numbers the rows in the order in which wholly alike ones are taken; without it they are numbered here."""
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    rows = docs.select(F.col(f"`{key}`").alias("key"), source_key(F.col(f"`{source}`")).alias("skey"), word_count(F.col(f"`{text}`")).alias("size"), key_hash(F.col(f"`{key}`")).alias("h"), key_hash(F.col(f"`{text}`")).alias("h2"), number.alias("n"))
    rows = stage(rows, "mix")
    totals = rows.groupBy("skey").agg(F.sum("size").alias("n")).orderBy("skey").limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = [(r["skey"], r["n"]) for r in totals]
    goal = targets(sizes, weights, share, max_repeats)
    repeats = {k: min(max_repeats, math.floor(goal[k] / n)) if n else 0 for k, n in sizes}
    ties, alike = {}, {}
    last = thresholds(rows, {k: goal[k] - repeats[k] * n for k, n in sizes}, ties)
    tied, finer = within(rows, "h", ties), {}
    by_text = thresholds(tied.withColumn("h", F.col("h2")), {k: b for k, (_, b) in ties.items()}, alike) if ties else {}
    if alike:
        finer = thresholds(within(tied, "h2", alike).withColumn("h", F.col("n")), {k: b for k, (_, b) in alike.items()})
    table = [(k, n, goal[k], repeats[k], last[k], ties.get(k, (-1,))[0], by_text.get(k, -1), alike.get(k, (-1,))[0], finer.get(k, -1)) for k, n in sizes]
    return rows, docs.sparkSession.createDataFrame(table, BUDGET_TYPE)


def within(rows: DataFrame, column: str, at: dict[str, tuple[int, float]]) -> DataFrame:
    """The rows of each source whose column has the value at the boundary."""
    places = rows.sparkSession.createDataFrame([(k, v) for k, (v, _) in at.items()], "skey string, value long")
    return rows.join(F.broadcast(places), "skey").where(F.col(column) == F.col("value")).drop("value")  # a row per source, at most max_sources


def times_taken(h: Column, h2: Column, n: Column, budget=F.col) -> Column:
    """How often the mix takes a row with these hashes and number, beside a joined budget table."""
    finer = (h2 <= budget("tie_threshold")) | ((h2 == budget("alike")) & (n <= budget("alike_threshold")))
    taken = (h <= budget("threshold")) | ((h == budget("tie")) & finer)
    return budget("repeats") + F.when(taken, 1).otherwise(0)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, budget = plan_mix(docs, "doc_id", "text", "source")
    out = rows.join(F.broadcast(budget), "skey")  # a row per source, at most max_sources
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * times_taken(F.col("h"), F.col("h2"), F.col("n"))).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT skey, sum(size)::BIGINT AS n, [3, 1, 2][((row_number() OVER (ORDER BY skey)) - 1) % 3 + 1] AS w FROM d GROUP BY skey
), o AS (
  SELECT *, 2.0::DOUBLE * n AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, skey) AS k FROM s
), p AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(n) OVER () AS total FROM o
), q AS (
  SELECT *, (1.5::DOUBLE * total - caps_before) / w_left AS level FROM p
), f AS (
  SELECT coalesce(min(k) FILTER (WHERE level * w < cap), 1e18) AS k0 FROM q
), t AS (
  SELECT skey, n, CASE WHEN k < k0 THEN cap ELSE (SELECT level FROM q, f WHERE q.k = f.k0) * w END AS target FROM q, f
), u AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(2, floor(target / n)) END::BIGINT AS repeats FROM t
), g AS (
  SELECT skey, h, sum(size) AS m, coalesce(sum(sum(size)) OVER (PARTITION BY skey ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM d GROUP BY skey, h
)
SELECT d.doc_id, d.size, u.n AS source_size, round(u.target, 6) AS target,
       (d.size * (u.repeats + CASE WHEN u.target - u.repeats * u.n > 0 AND 2 * (u.target - u.repeats * u.n - g.below) >= g.m THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u USING (skey) JOIN g ON g.skey = d.skey AND g.h = d.h
"""

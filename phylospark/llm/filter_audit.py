"""How filters interact: what each removes in every order, counted on the documents that really remain.

The orders of some filters form a trie. It is walked depth first: a node holds the documents that survive the filters above it as a persisted
DataFrame, and one aggregation counts, for each filter not yet applied, what that filter removes there. Orders that differ only in how the
same filters were arranged lead to the same survivors, so each set of filters is computed once (32 sets for five filters, 80 edges, in place
of 600 steps); a node that was reached before is not entered again. At most one path of survivors is persisted at a time.

Survivors hold no texts but what each filter says of a document, computed once, with its part and its labels; they come from a staged table,
so a lost executor costs the recomputation of what it held. Counts are summed by part before they are shuffled, and nothing of the corpus
is collected. A repeated text is found by its SHA-256; frequent ones are joined by broadcast of fewer than a thousand rows.

Defined cases: a null text is the empty one, a null part the empty string. Empty texts have no words, so they are short (A), not repetitive (B), not
upper-case (C), without symbols (D). A null doc_id is neither smaller nor larger than any other, so E never fails it nor fails others
for it. Rows of one doc_id with one text don't fail E for each other. Repeated rows count each. A document is good or toxic if any label row of its doc_id
says so; without one it is neither. An empty table gives an empty result. Columns beyond those named are ignored.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import join_hot, shared_dir, stage

MAX_FILTERS = 6
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under half of the words distinct; C: over 3 % upper-case characters; D: any of the listed symbols."""
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * upper.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def judged(docs: DataFrame, labels: DataFrame, doc: str, text: str, part: str) -> DataFrame:
    """part, a boolean column for each of the five filters (true: it fails), good, toxic; staged, a row for each document."""
    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = text_failures(F.col("text"))
    rows = stage(rows.select("doc_id", "part", *(v.alias(k) for k, v in own.items()), F.unhex(F.sha2("text", 256)).alias("digest")), "judged")
    first = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    rows = join_hot(rows, first, ["digest"], "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return stage(rows.join(marks, "doc_id", "left").select("part", *"ABCDE", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), "filters")


def count_edges(rows: DataFrame, filters: str, path: str) -> None:
    """Walk the trie; for every set of filters and each part that has survivors a row (state, part, kept, edges: filter to what it removes)."""
    seen: set[str] = set()

    def enter(state: str, survivors: DataFrame) -> None:
        seen.add(state)
        left = [f for f in filters if f not in state]
        counts = F.create_map(*(x for f in left for x in (F.lit(f), F.struct(*(F.count_if(c).alias(name) for name, c in (("removed", F.col(f)), ("good_lost", F.col(f) & F.col("good")), ("toxic_lost", F.col(f) & F.col("toxic"))))))))
        survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), counts.alias("edges")).select(F.lit(state).alias("state"), "*").write.mode("append").parquet(path)
        for f in left:
            after = "".join(sorted(state + f))
            if len(after) < len(filters) and after not in seen:  # nothing is left to remove below the last set
                rest = survivors.where(~F.col(f))
                if any(len(after) + 1 < len(filters) and "".join(sorted(after + g)) not in seen for g in left if g != f):  # it is read again
                    rest = rest.persist(StorageLevel.MEMORY_AND_DISK)
                enter(after, rest)
                rest.unpersist()

    enter("", rows)


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every part, order and step.
    rows: a staged table with part, good, toxic and a boolean column for each filter, named by one letter."""
    if not 0 < len(filters) <= MAX_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MAX_FILTERS} different letters, not {filters!r}")
    filters = "".join(sorted(filters))
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/staged/edges-{uuid.uuid4().hex}"
    count_edges(rows, filters, path)
    schema = "state string, part string, n long, edges map<string, struct<removed: long, good_lost: long, toxic_lost: long>>"
    edges = spark.read.schema(schema).parquet(path).select("state", "part", "n", F.explode("edges").alias("filter", "e")).select("state", "part", "filter", "n", "e.*")
    fails = sum((F.col(f).cast("int") for f in filters), F.lit(0))
    totals = F.create_map(*(x for f in filters for x in (F.lit(f), F.struct(F.count_if(F.col(f)).alias("fails"), F.count_if(F.col(f) & (fails == 1)).alias("alone")))))
    parts = stage(rows.groupBy("part").agg(totals.alias("totals")), "parts")
    orders = F.explode(F.lit(["".join(o) for o in permutations(filters)]))
    steps = parts.select("part", "totals", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("state", F.array_join(F.array_sort(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), "")), ""))
    steps = steps.join(edges, ["part", "state", "filter"], "left").na.fill(0, ["n", "removed", "good_lost", "toxic_lost"])
    steps = stage(steps.withColumn("of", F.element_at("totals", F.col("filter"))), "steps")
    sums = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    out = steps.join(sums, ["part", "filter"])
    return out.select("part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("of.fails") - F.col("removed")).alias("redundant"), F.col("of.alone").alias("unique_fails"), "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of the five filters by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(judged(docs, labels, "doc_id", "text", "lang"))


OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(translate(text, '{UPPER}', ''))) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(w.doc_id > first, false) THEN 'E' ELSE '' END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)
), z AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE hit AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(mask, f) AS hit, step > 1 AND mask <> translate(mask, before, '') AS earlier FROM g, s) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM z
"""

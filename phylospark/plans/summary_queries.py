"""Queries that summarise, and the event-time ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from phylospark.operators import summary
from phylospark.plans.tree_queries import table
from phylospark.sources.results import record
from phylospark.streaming import generations


def results(spark, sf_dir):
    """Orders in the role of result records, as the lines that runs write, parsed again."""
    line = F.format_string("{'GenTreeSize': %d, 'TreeSize': %d, 'NumBiopsies': %d, 'biopsy_size': %s, 'RPercentile': %d, 'Result': %s, 'gens': (1, 2)}", F.col("o_orderkey") % 2600, F.element_at(F.lit([6, 8, 10, 14, 7]), (F.col("o_orderkey") % 5 + 1).cast("int")), F.col("o_orderkey") % 2 + 2, (F.col("o_orderkey") % 3 + 1).cast("string"), F.col("o_custkey") % 4 * 10, F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", record(line).alias("r")).select("o_orderkey", "r.*")


RESULTS = """r AS (SELECT o_orderkey, o_orderkey % 2600 AS "GenTreeSize", [6, 8, 10, 14, 7][o_orderkey % 5 + 1]::BIGINT AS "TreeSize", o_orderkey % 2 + 2 AS "NumBiopsies", (o_orderkey % 3 + 1)::DOUBLE AS biopsy_size, (o_custkey % 4 * 10)::DOUBLE AS "RPercentile", round(o_totalprice, 2)::DECIMAL(18,2)::DOUBLE AS "Result" FROM orders)"""


def results_parse(spark, sf_dir):
    return results(spark, sf_dir)


def bin_labels(spark, sf_dir):
    rows = summary.labelled(results(spark, sf_dir))
    key = summary.sample_rank(F.col("sample"))
    return rows.select("o_orderkey", "size_bin", "tree_biopsies", F.coalesce("tree_rank", F.lit(0)).alias("tree_rank"), "sample", key["size"].alias("sample_size"), key["percentile"].alias("sample_percentile"))


def facet_titles(spark, sf_dir):
    rows = summary.labelled(results(spark, sf_dir)).where("tree_rank IS NOT NULL").select("tree_rank", "tree_biopsies").distinct()
    return rows.select("tree_rank", summary.facet_title(F.col("tree_biopsies")).alias("title"))


def box_stats(spark, sf_dir):
    rows = summary.box_statistics(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return rows.select("o_orderpriority", "o_orderstatus", "n", "n_outliers", *(F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")))


def box_stats_hot(spark, sf_dir):
    """All prices of line items as one group, beside a group for each flag: quartiles by ranges, as for groups of any size."""
    rows = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("all"), F.col("l_returnflag"))).alias("part"), F.col("l_extendedprice").alias("price"))
    rows = summary.box_statistics(rows, "price", "part", held=1000)
    return rows.select("part", "n", "n_outliers", *(F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")))


def box_outliers(spark, sf_dir):
    """Orders beyond whiskers of half the quartile distance."""
    rows = summary.outliers(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus", reach=0.5, held=100)
    return rows.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "high")


def timer_means(spark, sf_dir):
    rows = summary.mean_by_label(table(spark, sf_dir, "events"), "event_type", "value")
    return rows.select("event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def event_buckets(spark, sf_dir):
    rows = generations.bucket_counts(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "event_type", "n", F.round("total", 6).alias("total"))


def event_sessions(spark, sf_dir):
    rows = generations.sessions(table(spark, sf_dir, "events"), "6 hours")
    return rows.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


QUERIES = {
    "results_parse": (results_parse, f"WITH {RESULTS} SELECT * FROM r"),
    "bin_labels": (bin_labels, f"""WITH {RESULTS}, l AS (SELECT *, "TreeSize" || 'L-' || "NumBiopsies" || 'B' AS label FROM r)
SELECT o_orderkey, CASE WHEN "GenTreeSize" > 0 AND "GenTreeSize" <= 1000 THEN '<1000' WHEN "GenTreeSize" > 1000 AND "GenTreeSize" <= 1500 THEN '1000–1500' WHEN "GenTreeSize" > 1500 AND "GenTreeSize" <= 2000 THEN '1500–2000' WHEN "GenTreeSize" > 2000 THEN '>2000' END AS size_bin,
  CASE WHEN list_position({list(summary.TREE_LABELS)}, label) > 0 THEN label END AS tree_biopsies, coalesce(list_position({list(summary.TREE_LABELS)}, label), 0)::INT AS tree_rank,
  printf('%.1f', biopsy_size) || ' | ' || "RPercentile"::DECIMAL(9,1)::VARCHAR AS sample, biopsy_size AS sample_size, "RPercentile" AS sample_percentile FROM l"""),
    "facet_titles": (facet_titles, f"""WITH {RESULTS} SELECT DISTINCT list_position({list(summary.TREE_LABELS)}, "TreeSize" || 'L-' || "NumBiopsies" || 'B')::INT AS tree_rank, 'Trees: ' || "TreeSize" || ' levels | ' || "NumBiopsies" || ' biopsies' AS title FROM r WHERE list_position({list(summary.TREE_LABELS)}, "TreeSize" || 'L-' || "NumBiopsies" || 'B') > 0"""),
    "box_stats": (box_stats, """WITH q AS (SELECT o_orderpriority, o_orderstatus, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY ALL),
b AS (SELECT o.*, q[1] AS q1, q[2] AS median, q[3] AS q3, o_totalprice >= q[1] - 1.5 * (q[3] - q[1]) AND o_totalprice <= q[3] + 1.5 * (q[3] - q[1]) AS inside FROM orders o JOIN q USING (o_orderpriority, o_orderstatus))
SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum((NOT inside)::INT)::BIGINT AS n_outliers, round(min(o_totalprice) FILTER (WHERE inside), 6) AS low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max(o_totalprice) FILTER (WHERE inside), 6) AS high FROM b GROUP BY o_orderpriority, o_orderstatus, q1, median, q3"""),
    "box_stats_hot": (box_stats_hot, """WITH r AS (SELECT 'all' AS part, l_extendedprice AS price FROM lineitem UNION ALL SELECT l_returnflag, l_extendedprice FROM lineitem), q AS (SELECT part, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM r GROUP BY ALL),
b AS (SELECT r.*, q[1] AS q1, q[2] AS median, q[3] AS q3, price >= q[1] - 1.5 * (q[3] - q[1]) AND price <= q[3] + 1.5 * (q[3] - q[1]) AS inside FROM r JOIN q USING (part))
SELECT part, count(*) AS n, sum((NOT inside)::INT)::BIGINT AS n_outliers, round(min(price) FILTER (WHERE inside), 6) AS low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max(price) FILTER (WHERE inside), 6) AS high FROM b GROUP BY part, q1, median, q3"""),
    "box_outliers": (box_outliers, """WITH q AS (SELECT o_orderpriority, o_orderstatus, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY ALL)
SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, o_totalprice > q[3] AS high FROM orders o JOIN q USING (o_orderpriority, o_orderstatus) WHERE o_totalprice < q[1] - 0.5 * (q[3] - q[1]) OR o_totalprice > q[3] + 0.5 * (q[3] - q[1])"""),
    "timer_means": (timer_means, "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL"),
    "event_buckets": (event_buckets, "SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"),
    "event_sessions": (event_sessions, """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, k"""),
}

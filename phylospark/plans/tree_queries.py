"""Queries over trees made of region, nation and customer: all customers, and those with an even key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.functions.profiles import multiset_distance
from phylospark.functions.staging import stage
from phylospark.operators import clusters, layout, similarity
from phylospark.sources import newick


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_trees(spark, sf_dir: str) -> DataFrame:
    """(tree_id, node_id, parent_id, label) of both trees; the root has no label, a customer's is the market segment."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda base, c: (F.lit(base) + F.col(c)).cast("long")
    one = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("label"))
    upper = one.union(region.select(key(1000, "r_regionkey"), F.lit(0).cast("long"), "r_name")).union(nation.select(key(10000, "n_nationkey"), key(1000, "n_regionkey"), "n_name"))
    people = customer.select(key(1_000_000, "c_custkey").alias("node_id"), key(10000, "c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("label"))
    tree = lambda name, own: upper.union(own).select(F.lit(name).alias("tree_id"), "*")
    return tree("all", people).unionByName(tree("even", people.where("node_id % 2 = 0")))


TREES = """nodes AS (
  SELECT t.t AS tree_id, n.* FROM (VALUES ('all'), ('even')) t(t), (
    SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, NULL::VARCHAR AS label
    UNION ALL SELECT 1000 + r_regionkey, 0, r_name FROM region
    UNION ALL SELECT 10000 + n_nationkey, 1000 + n_regionkey, n_name FROM nation) n
  UNION ALL SELECT t.t, 1000000 + c_custkey, 10000 + c_nationkey, c_mktsegment FROM (VALUES ('all'), ('even')) t(t), customer WHERE t.t = 'all' OR c_custkey % 2 = 0
), clo AS (
  SELECT tree_id, node_id, node_id AS anc, parent_id AS up FROM nodes
  UNION ALL SELECT c.tree_id, c.node_id, n.node_id, n.parent_id FROM clo c JOIN nodes n ON n.tree_id = c.tree_id AND n.node_id = c.up
)"""


def el(where: str = "") -> str:
    return f"el AS (SELECT c.tree_id, c.anc, n.label, count(*)::BIGINT AS cnt FROM clo c JOIN nodes n ON n.tree_id = c.tree_id AND n.node_id = c.node_id WHERE n.label IS NOT NULL {where} GROUP BY ALL)"


#: The same trees down to nations, under a named root; the second has nations with an even key and regions that have one.
UPPER = TREES.replace(TREES[TREES.index("  SELECT t.t"):TREES.index("), clo AS")], """  SELECT t.t AS tree_id, n.* EXCLUDE (even) FROM (VALUES ('all'), ('even')) t(t), (
    SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, 'world'::VARCHAR AS label, true AS even
    UNION ALL SELECT 1000 + r_regionkey, 0, r_name, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT 10000 + n_nationkey, 1000 + n_regionkey, n_name, n_nationkey % 2 = 0 FROM nation) n WHERE t.t = 'all' OR n.even
""")


def similarity_sql(where: str = "", as_sets: bool = False, trees: str = TREES) -> str:
    """The formula with all pairs of different clusters."""
    m = ("least(sum((tree_id = 'all')::INT), 1)", "least(sum((tree_id = 'even')::INT), 1)") if as_sets else ("sum((tree_id = 'all')::INT)", "sum((tree_id = 'even')::INT)")
    counted = "WHERE sig <> ''" if as_sets else ""
    return f"""WITH RECURSIVE {trees}, {el(where)}, cl AS (
  SELECT n.tree_id, n.node_id AS anc, coalesce(string_agg(e.label || '=' || e.cnt, '|' ORDER BY e.label), '') AS sig, coalesce(sum(e.cnt), 0) AS size
  FROM nodes n LEFT JOIN el e ON e.tree_id = n.tree_id AND e.anc = n.node_id GROUP BY ALL
), k AS (SELECT sig, any_value(size) AS size, {m[0]} AS ma, {m[1]} AS mb, min(struct_pack(t := tree_id, a := anc)) AS rep FROM cl GROUP BY sig
), w AS (SELECT * FROM k {counted}
), ke AS (SELECT k.sig, e.label, e.cnt FROM w k JOIN el e ON e.tree_id = k.rep.t AND e.anc = k.rep.a
), i AS (SELECT x.sig AS a, y.sig AS b, sum(least(x.cnt, y.cnt)) AS i FROM ke x JOIN ke y USING (label) GROUP BY ALL
), tot AS (SELECT sum(ma) AS na, sum(mb) AS nb, (SELECT count(*) FROM k) AS u FROM w
), p AS (
  SELECT x.ma, y.mb, x.mb AS xb, y.ma AS ya, 1 - coalesce(i.i, 0) / (x.size + y.size - coalesce(i.i, 0))::DOUBLE AS j
  FROM w x JOIN w y ON x.sig <> y.sig AND x.ma > 0 AND y.mb > 0 LEFT JOIN i ON i.a = x.sig AND i.b = y.sig
)
SELECT 'all-even' AS pair_id, round(1 - (coalesce((SELECT sum(ma * mb * j) FROM p WHERE ya = 0), 0) / (na * u) + coalesce((SELECT sum(ma * mb * j) FROM p WHERE xb = 0), 0) / (nb * u)), 9) AS similarity,
       na::BIGINT AS n_left, nb::BIGINT AS n_right, u::BIGINT AS n_union FROM tot"""


ALLOWED = ("BUILDING", "MACHINERY", "ASIA", "FRANCE", "NATION_3", "REGION_1")
PAIR = [("all-even", "all", "even")]


def pairs(spark) -> DataFrame:
    return spark.createDataFrame(PAIR, "pair_id string, left_tree string, right_tree string")


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("similarity", F.round("similarity", 9)).withColumns({c: F.col(c).cast("long") for c in ("n_left", "n_right", "n_union")})


def grf_region_tree(spark, sf_dir):
    return rounded(similarity.similarity(label_trees(spark, sf_dir), pairs(spark)))


def rgrf_restricted(spark, sf_dir):
    return rounded(similarity.shared_label_similarity(label_trees(spark, sf_dir), pairs(spark)))


def bgrf_allowed(spark, sf_dir):
    return rounded(similarity.given_label_similarity(label_trees(spark, sf_dir), pairs(spark), spark.createDataFrame([(x,) for x in ALLOWED], "label string")))


def subtree_counts(spark, sf_dir):
    return clusters.elements(label_trees(spark, sf_dir))


def cluster_signatures(spark, sf_dir):
    return clusters.signatures(clusters.elements(label_trees(spark, sf_dir)))


def cluster_classes(spark, sf_dir):
    return clusters.numbered(label_trees(spark, sf_dir))


def tree_closure(spark, sf_dir):
    return clusters.closure(label_trees(spark, sf_dir))


def leaf_internal_labels(spark, sf_dir):
    return clusters.leaf_and_inner_labels(label_trees(spark, sf_dir))


def cluster_set_ops(spark, sf_dir):
    """How many different labels are in both trees' leaves, in either, and in the left one's alone."""
    labels = clusters.leaf_and_inner_labels(label_trees(spark, sf_dir)).select("tree_id", "label").distinct()
    a, b = (labels.where(F.col("tree_id") == t).select("label") for t in ("all", "even"))
    rows = a.union(b).distinct().select(F.lit("union").alias("kind"), "label").unionAll(a.intersect(b).select(F.lit("both"), "label")).unionAll(a.join(b, "label", "left_anti").select(F.lit("left only"), "label"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def newick_nodes(spark, sf_dir):
    """Nations under regions as Newick texts, parsed again."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    texts = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("inner"))
    found = newick.nodes(texts.select(F.col("r_name").alias("tree_id"), F.concat(F.lit("("), "inner", F.lit(")"), "r_name", F.lit(";")).alias("newick")))
    up = found.select("tree_id", F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    return found.join(up, ["tree_id", "parent_id"], "left").select("tree_id", "label", "parent_label", "is_root")


def newick_similarity(spark, sf_dir):
    """Two trees given as Newick texts: nations under regions, and those with an even key."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")

    def tree(name, rows):
        inner = rows.groupBy("r_name").agg(text("n_name").alias("below")).select(F.concat(F.lit("("), "below", F.lit(")"), "r_name").alias("part"))
        return inner.agg(F.concat(F.lit("("), text("part"), F.lit(")world;")).alias("newick")).select(F.lit(name).alias("tree_id"), "newick")

    nodes = stage(newick.nodes(tree("all", rows).unionByName(tree("even", rows.where("n_nationkey % 2 = 0")))), "newick")
    roots = nodes.where("is_root").select("tree_id", F.col("node_id").alias("root"))
    return rounded(similarity.similarity(nodes.drop("is_root"), pairs(spark), roots))


def jaccard_multiset(spark, sf_dir):
    """The multiset distance of market segments between nations of a region."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    sets = counts.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("label", "cnt"))).alias("elems"))
    nation = table(spark, sf_dir, "nation").join(sets, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_regionkey", "n_nationkey", F.coalesce("elems", F.array().cast("array<struct<label: string, cnt: bigint>>")).alias("elems"))
    x, y = nation.alias("x"), nation.alias("y")
    rows = x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey")))
    return rows.select(F.col("x.n_nationkey").alias("left_nation"), F.col("y.n_nationkey").alias("right_nation"), F.round(multiset_distance(F.col("x.elems"), F.col("y.elems")), 9).alias("distance"))


def layout_levels(spark, sf_dir):
    own = stage(layout.tree_layout(label_trees(spark, sf_dir)), "layout")
    return own.select("tree_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def layout_edges(spark, sf_dir):
    nodes = label_trees(spark, sf_dir)
    rows = layout.edge_layout(nodes, layout.tree_layout(nodes), F.when(F.col("node_id") % 3 == 0, "").otherwise(F.col("label")))
    return rows.select("tree_id", "child_id", F.round("mid_x", 6).alias("mid_x"), F.round("mid_y", 6).alias("mid_y"), "colour")


def layout_extent(spark, sf_dir):
    rows = layout.extent(layout.tree_layout(label_trees(spark, sf_dir)), 1.0, 2.0)
    return rows.select("tree_id", *(F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")))


LAYOUT = f"""WITH RECURSIVE {TREES}, leaf AS (
  SELECT tree_id, node_id, row_number() OVER (PARTITION BY tree_id ORDER BY node_id) - 1 AS place FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id)
), depth AS (SELECT tree_id, node_id, count(*) - 1 AS depth FROM clo GROUP BY ALL
), spread AS (SELECT c.tree_id, c.anc AS node_id, (min(place) + max(place)) / 2.0::DOUBLE AS middle FROM clo c JOIN leaf l ON l.tree_id = c.tree_id AND l.node_id = c.node_id GROUP BY ALL
), lay AS (SELECT d.tree_id, d.node_id, middle * 1.25::DOUBLE AS x, (-depth)::DOUBLE AS y FROM depth d JOIN spread s USING (tree_id, node_id)
)"""

SIMPLE = f"WITH RECURSIVE {TREES}"
SHARED = """AND n.label IN (
  SELECT label FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = x.tree_id AND c.parent_id = x.node_id)
  UNION SELECT label FROM nodes x WHERE EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = x.tree_id AND c.parent_id = x.node_id) GROUP BY label HAVING count(DISTINCT tree_id) = 2)"""

QUERIES = {
    "grf_region_tree": (grf_region_tree, similarity_sql()),
    "rgrf_restricted": (rgrf_restricted, similarity_sql(SHARED)),
    "bgrf_allowed": (bgrf_allowed, similarity_sql(f"AND n.label IN {ALLOWED}", as_sets=True)),
    "subtree_counts": (subtree_counts, f"{SIMPLE}, {el()} SELECT tree_id, anc, label, cnt FROM el"),
    "cluster_signatures": (cluster_signatures, f"{SIMPLE}, {el()} SELECT tree_id, anc, string_agg(label || '=' || cnt, '|' ORDER BY label || '=' || cnt) AS signature FROM el GROUP BY ALL"),
    "cluster_classes": (cluster_classes, f"""{SIMPLE}, {el()}, s AS (
  SELECT n.tree_id, n.node_id AS anc, coalesce(string_agg(e.label || '=' || e.cnt, '|' ORDER BY e.label), '') AS sig FROM nodes n LEFT JOIN el e ON e.tree_id = n.tree_id AND e.anc = n.node_id GROUP BY ALL
), g AS (SELECT sig, min(struct_pack(t := tree_id, a := anc)) AS f, count(*) AS n FROM s GROUP BY sig)
SELECT tree_id, anc, f.t AS first_tree, f.a AS first_node, n FROM s JOIN g USING (sig)"""),
    "tree_closure": (tree_closure, f"{SIMPLE} SELECT tree_id, node_id, anc FROM clo"),
    "leaf_internal_labels": (leaf_internal_labels, f"{SIMPLE} SELECT DISTINCT tree_id, label, NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id) AS is_leaf FROM nodes n WHERE label IS NOT NULL"),
    "cluster_set_ops": (cluster_set_ops, f"""{SIMPLE}, a AS (SELECT DISTINCT label FROM nodes WHERE tree_id = 'all' AND label IS NOT NULL), b AS (SELECT DISTINCT label FROM nodes WHERE tree_id = 'even' AND label IS NOT NULL)
SELECT kind, n FROM (SELECT 'union' AS kind, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n UNION ALL SELECT 'both', (SELECT count(*) FROM a JOIN b USING (label)) UNION ALL SELECT 'left only', (SELECT count(*) FROM a WHERE label NOT IN (SELECT label FROM b))) WHERE n > 0"""),
    "newick_nodes": (newick_nodes, """SELECT r_name AS tree_id, n_name AS label, r_name AS parent_label, false AS is_root FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT r_name, r_name, NULL, true FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "newick_similarity": (newick_similarity, similarity_sql(trees=UPPER)),
    "jaccard_multiset": (jaccard_multiset, """WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS label, count(*) AS cnt FROM customer GROUP BY ALL), s AS (SELECT n_nationkey AS k, coalesce(sum(cnt), 0) AS size FROM nation LEFT JOIN c ON k = n_nationkey GROUP BY ALL),
p AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey),
i AS (SELECT a, b, coalesce(sum(least(x.cnt, y.cnt)) FILTER (WHERE x.cnt IS NOT NULL AND y.cnt IS NOT NULL), 0) AS i FROM p LEFT JOIN c x ON x.k = a LEFT JOIN c y ON y.k = b AND y.label = x.label GROUP BY ALL)
SELECT a AS left_nation, b AS right_nation, round(CASE WHEN sa.size + sb.size - i = 0 THEN 0 ELSE 1 - i / (sa.size + sb.size - i)::DOUBLE END, 9) AS distance FROM i JOIN s sa ON sa.k = a JOIN s sb ON sb.k = b"""),
    "layout_levels": (layout_levels, f"{LAYOUT} SELECT tree_id, node_id, round(x, 6) AS x, round(y, 6) AS y FROM lay"),
    "layout_edges": (layout_edges, f"""{LAYOUT} SELECT n.tree_id, n.node_id AS child_id, round((a.x + b.x) / 2, 6) AS mid_x, round((a.y + b.y) / 2, 6) AS mid_y, CASE WHEN n.node_id % 3 = 0 OR coalesce(n.label, '') = '' THEN 'green' ELSE 'red' END AS colour
FROM nodes n JOIN lay a ON a.tree_id = n.tree_id AND a.node_id = n.parent_id JOIN lay b ON b.tree_id = n.tree_id AND b.node_id = n.node_id"""),
    "layout_extent": (layout_extent, f"{LAYOUT} SELECT tree_id, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y) * 2, 6) AS min_y, round(max(y) * 2, 6) AS max_y FROM lay GROUP BY tree_id"),
}

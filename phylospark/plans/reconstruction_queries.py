"""Queries over distances, linking, joining, and the whole experiment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from phylospark.functions import profiles
from phylospark.functions.staging import large, stage
from phylospark.operators import biopsy as sampling
from phylospark.operators import clusters, distance, joining, layout, linking
from phylospark.plans.experiment import run_experiment
from phylospark.plans.locus_queries import GENOME, genome
from phylospark.plans.tree_queries import table
from phylospark.sources import loci
from phylospark.sources.config import Model

PER_RUN = 12


def cells(spark, sf_dir):
    """Every customer as a sampled cell: as many runs a nation as it has twelves, so that no matrix grows with the table; the last run takes the
    rest too. Four cells are a level; two share their cell with one of the level before."""
    nation = Window.partitionBy("c_nationkey")
    place, size = F.row_number().over(nation.orderBy("c_custkey")) - 1, F.count(F.lit(1)).over(nation)
    rows = table(spark, sf_dir, "customer").withColumns({"place": place, "size": size})
    rows = rows.withColumn("part", F.least(F.expr(f"place div {PER_RUN}"), F.greatest(F.expr(f"size div {PER_RUN} - 1"), F.lit(0))))
    rows = rows.withColumn("i", F.col("place") - F.col("part") * PER_RUN)
    shared = F.when(F.col("i").isin(7, 11), F.col("i") - 4).otherwise(F.col("i"))
    return rows.select(F.concat_ws("-", "c_nationkey", "part").alias("run_id"), (F.col("i") / 4).cast("int").alias("level"), (F.col("i") % 4).cast("int").alias("ord"), shared.cast("long").alias("cell_id"), F.col("i").cast("int").alias("at"), genome(F.col("c_custkey"), F.col("c_nationkey")).alias("genome"))


CELLS = f"""c AS (SELECT run_id, run_no, i // 4 AS level, i % 4 AS ord, CASE WHEN i IN (7, 11) THEN i - 4 ELSE i END AS cell_id, i AS idx, genome FROM (
  SELECT c_nationkey || '-' || part AS run_id, c_nationkey + part AS run_no, place - part * {PER_RUN} AS i, list_transform(range(0, 10), lambda k: ((c_custkey * (k + 3) + c_nationkey) % 5)::INT) AS genome FROM (
    SELECT *, least(place // {PER_RUN}, greatest(size // {PER_RUN} - 1, 0)) AS part FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer))))"""


def run_number(run):
    """The sum of a run's nation and part."""
    parts = F.split(run, "-")
    return parts[0].cast("int") + parts[1].cast("int")


def between(own):
    """A table of distances between the cells of a run, made of their places."""
    own = own.select("run_id", "at", "cell_id")
    left = own.select("run_id", F.col("at").alias("i"), F.col("cell_id").alias("id_i"))
    right = own.select("run_id", F.col("at").alias("j"), F.col("cell_id").alias("id_j"))
    far = F.when(F.col("i") == F.col("j"), 0).otherwise((F.col("i") * F.col("j") * 7 + F.col("i") + F.col("j")) % 6 + 1)
    return left.join(large(right), "run_id").select("run_id", "i", "j", "id_i", "id_j", far.cast("double").alias("dist"))


def distances(spark, sf_dir):
    return between(cells(spark, sf_dir))


DIST = "d AS (SELECT x.run_id, x.idx AS i, y.idx AS j, x.cell_id AS id_i, y.cell_id AS id_j, CASE WHEN x.idx = y.idx THEN 0 ELSE (x.idx * y.idx * 7 + x.idx + y.idx) % 6 + 1 END::DOUBLE AS dist FROM c x JOIN c y USING (run_id))"
CANDIDATES = f"""{CELLS}, {DIST}, ix AS (SELECT c.run_id, c.level, c.ord, c.cell_id, c.genome, m.idx FROM c JOIN (SELECT run_id, cell_id, max(idx) AS idx FROM c GROUP BY ALL) m USING (run_id, cell_id)),
ca AS (SELECT y.run_id, y.level, y.ord AS y_ord, y.cell_id AS y_cell, x.ord AS x_ord, x.cell_id AS x_cell, d.dist, x.cell_id = y.cell_id AS same,
  len(list_filter(range(1, 11), lambda k: x.genome[k] = 0 AND y.genome[k] > 0)) > 0 AS excluded
  FROM ix y JOIN ix x ON x.run_id = y.run_id AND x.level + 1 = y.level JOIN d ON d.run_id = y.run_id AND d.i = y.idx AND d.j = x.idx WHERE d.dist <= 4)"""


def found(spark, sf_dir):
    return linking.candidates(cells(spark, sf_dir), distances(spark, sf_dir), 4)


def matrix_long(spark, sf_dir):
    return distances(spark, sf_dir)


def matrix_text(spark, sf_dir):
    from phylospark.sources.profiles import matrix_lines

    return matrix_lines(distances(spark, sf_dir), "run_id")


def radius_candidates(spark, sf_dir):
    return found(spark, sf_dir).select("run_id", "level", "y_ord", "x_ord", "dist")


def zero_constraint(spark, sf_dir):
    return found(spark, sf_dir).where("excluded AND NOT same").select("run_id", "level", "y_ord", "x_ord")


def same_id_link(spark, sf_dir):
    return found(spark, sf_dir).where("same").select("run_id", "level", "y_ord", "x_ord", "y_cell")


def nearest_ancestor(spark, sf_dir):
    return linking.nearest(found(spark, sf_dir)).select("run_id", "level", "y_ord", "y_cell", "x_ord", "x_cell", "dist")


def layer_registration(spark, sf_dir):
    return linking.registered(cells(spark, sf_dir), distances(spark, sf_dir)).select("run_id", "level", "ord", "node_id")


def biopsy_cells(spark, sf_dir):
    rows = sampling.cells_by_level(cells(spark, sf_dir))
    return rows.select("run_id", "level", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"))


def biopsy_pooled(spark, sf_dir):
    return sampling.pooled(cells(spark, sf_dir)).select("run_id", "level", "ord", "cell_id")


def biopsy_guard(spark, sf_dir):
    few = cells(spark, sf_dir).where((F.col("level") == 0) & (F.col("ord") < run_number(F.col("run_id")) % 5))
    return sampling.large_enough(few)


def cell_lookup(spark, sf_dir):
    """The first cell of each run that has a given identifier."""
    rows = cells(spark, sf_dir).where(F.col("cell_id") == 7 - run_number(F.col("run_id")) % 5)
    return rows.groupBy("run_id").agg(F.min_by("at", F.struct("level", "ord")).alias("found"))


def visible_nodes(spark, sf_dir):
    nodes = cells(spark, sf_dir).select("run_id", F.col("at").cast("long").alias("node_id"), "cell_id")
    sampled = cells(spark, sf_dir).where("level = 1").select("run_id", "cell_id")
    return layout.visible(nodes, nodes.where("node_id IN (0, 1)"), sampled).select("run_id", "node_id")


def nj_q_step(spark, sf_dir):
    rows = joining.step(distances(spark, sf_dir).select("run_id", "i", "j", "dist"))
    return rows.select("run_id", "i", "j", *(F.round(c, 9).alias(c) for c in ("q", "dist", "limb_i", "limb_j")))


def pairs(spark, sf_dir):
    """Neighbouring orders' profiles."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", genome(F.col("o_orderkey"), F.col("o_custkey")).alias("u"), genome(F.col("o_custkey"), F.col("o_orderkey")).alias("v"))
    return rows


ORDER_PAIRS = f"p AS (SELECT o_orderkey, {GENOME} AS u, list_transform(range(0, 10), lambda i: ((o_custkey * (i + 3) + o_orderkey) % 5)::INT) AS v FROM orders)"
PAIRS = f"""{ORDER_PAIRS},
k AS (SELECT o_orderkey, pos, v[pos] - u[pos] AS d FROM p, range(1, 11) r(pos) WHERE u[pos] <> 0), s AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY o_orderkey ORDER BY pos), 0) AS before, lead(d) OVER (PARTITION BY o_orderkey ORDER BY pos) IS NULL AS last FROM k)"""


def cnp_run_distance(spark, sf_dir):
    return pairs(spark, sf_dir).select("o_orderkey", profiles.flat_runs(F.col("u"), F.col("v")).cast("int").alias("runs"))


def cnp_breakpoint_bound(spark, sf_dir):
    return pairs(spark, sf_dir).select("o_orderkey", profiles.breakpoint_bound(F.col("u"), F.col("v")).alias("bound"))


def cnp_event_distance(spark, sf_dir):
    """The distance and whether it is exact; it lies between the two bounds (tests hold that)."""
    return pairs(spark, sf_dir).withColumn("d", distance.event_distance("u", "v")).select("o_orderkey", "d.dist", "d.exact")


def distance_matrix(spark, sf_dir):
    """The measured distances between the cells of each run."""
    rows = cells(spark, sf_dir).select("run_id", F.col("at").alias("ord"), "cell_id", "genome")
    return distance.matrix(rows)


def near_pairs(spark, sf_dir, keep_lost=False):
    own = stage(cells(spark, sf_dir).select("run_id", F.col("at").alias("key"), "genome"), "own")
    return distance.near(own, own, 3, keep_lost).select("run_id", "x", "y", "dist")


def near_ancestors(spark, sf_dir):
    """Pairs within the radius in which the second cell can descend from the first."""
    return near_pairs(spark, sf_dir, True)


def layered_within(spark, sf_dir):
    """Trees from near pairs only, on measured distances; every cell has an identifier of its own."""
    return written(linking.reconstruct_within(cells(spark, sf_dir).withColumn("cell_id", F.col("at").cast("long")), 4))


#: The distance of each pair of profiles in g (u, v): masks of breakpoints that sum to zero, and the longest chain of masks that hold one another.
MEASURED = """gn AS (SELECT u, v, row_number() OVER () AS k, list_filter(list_transform(range(1, len(u) + 1), lambda i: CASE WHEN u[i] <> 0 THEN v[i] - u[i] END), lambda x: x IS NOT NULL) AS d FROM (SELECT DISTINCT u, v FROM g)),
bp AS (SELECT u, v, k, list_filter(list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) - CASE WHEN i > 1 THEN d[i - 1] ELSE 0 END), lambda x: x <> 0) AS s FROM gn),
z AS MATERIALIZED (SELECT k, mask FROM bp, range(1, 2048) r(mask) WHERE mask < (1 << len(s)) AND list_sum(list_transform(range(1, len(s) + 1), lambda i: ((mask >> (i - 1)) & 1) * s[i])) = 0),
ch AS (SELECT k, mask, 1 AS n FROM z UNION SELECT z.k, z.mask, ch.n + 1 FROM ch JOIN z ON z.k = ch.k AND z.mask <> ch.mask AND z.mask & ch.mask = ch.mask),
far AS (SELECT u, v, (len(s) - coalesce(n, 0))::INT AS dist FROM bp LEFT JOIN (SELECT k, max(n) AS n FROM ch GROUP BY k) USING (k))"""
RUN_PAIRS = f"WITH RECURSIVE {CELLS}, g AS (SELECT x.run_id, x.idx AS i, y.idx AS j, x.cell_id AS id_i, y.cell_id AS id_j, x.genome AS u, y.genome AS v FROM c x JOIN c y USING (run_id)), {MEASURED}"
NEAR_SQL = f"{RUN_PAIRS} SELECT run_id, i::INT AS x, j::INT AS y, dist::DOUBLE AS dist FROM g JOIN far USING (u, v) WHERE dist <= 3"


def trees(spark, sf_dir, pooled=False, shared=False):
    rows = stage(cells(spark, sf_dir), "cells")
    return linking.reconstruct(rows, stage(between(rows), "distances"), 4, pooled, shared)


def written(rows):
    """Identifiers that may be missing as texts."""
    return rows.select("run_id", "node_id", F.col("parent_id").cast("string").alias("parent_id"), F.col("cell_id").cast("string").alias("cell_id"), "level", F.round("weight", 9).alias("weight"))


def nj_full(spark, sf_dir):
    return written(trees(spark, sf_dir, pooled=True))


def nj_shared(spark, sf_dir):
    """Pooled trees in which a cell that was sampled twice is one node under two parents."""
    return written(trees(spark, sf_dir, pooled=True, shared=True))


def shared_counts(spark, sf_dir):
    """Cells below the joined nodes of these, by the number of paths."""
    rows = stage(trees(spark, sf_dir, pooled=True, shared=True), "shared")
    found = clusters.elements(rows.select(F.col("run_id").alias("tree_id"), "node_id", "parent_id", F.col("cell_id").alias("label")))
    return found.select(F.col("tree_id").alias("run_id"), F.col("anc").alias("node_id"), F.col("label").alias("cell_id"), F.col("cnt").alias("paths"))


def layered_full(spark, sf_dir):
    return written(trees(spark, sf_dir))


def layered_layout(spark, sf_dir):
    return layout.layered_layout(stage(trees(spark, sf_dir), "layered"))



def biopsy_highlights(spark, sf_dir):
    nodes = cells(spark, sf_dir).select("run_id", F.col("at").cast("long").alias("node_id"), "cell_id")
    return layout.highlights(nodes, cells(spark, sf_dir))


def distance_labels(spark, sf_dir):
    return distances(spark, sf_dir).where("i < j").select("run_id", "i", "j", layout.distance_text(F.col("dist") / 3).alias("label"))


MODEL = Model(5, "fitness", "2", 0.02, 0.5, 1.0, 0.5, 0.01, genome_length=10, initial_copies=2, telomeres=True, telomere_share=0.1, telomere_instability=0.1, crucial=True)


LIVELY = replace(MODEL, event_prob=0.1)


def experiment(spark, sf_dir):
    """Simulation to scores, a run for each nation."""
    runs = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey")).alias("run_id"), (F.col("n_nationkey") + 700).alias("seed"))
    return run_experiment(runs, loci.resolve(loci.constant_loci(spark, LIVELY), LIVELY), LIVELY, [2, 4, 5], fraction=0.5)


#: Neighbour joining of items (run_id, pos, node, idx): m holds the matrix of every step; the item that a step makes comes after all others.
JOINING = """m AS (
  SELECT x.run_id, 0 AS step, x.n0, x.pos AS a, y.pos AS b, (CASE WHEN x.idx = y.idx THEN 0 ELSE (x.idx * y.idx * 7 + x.idx + y.idx) % 6 + 1 END)::DOUBLE AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n0 FROM items) x JOIN items y USING (run_id) WHERE x.n0 > 1
  UNION ALL (
    WITH t AS (SELECT *, sum(d) OVER (PARTITION BY run_id, a) AS ta, sum(d) OVER (PARTITION BY run_id, b) AS tb, count(*) OVER (PARTITION BY run_id, a) AS n FROM m),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (n - 2) * d - ta - tb, a, b) AS rn FROM t WHERE n > 2 AND a < b) WHERE rn = 1),
    k AS (SELECT t.run_id, t.step, t.n0, t.b AS k, sum(t.d) AS dsum, any_value(f.d) AS dij FROM t JOIN f ON f.run_id = t.run_id AND t.a IN (f.a, f.b) AND t.b NOT IN (f.a, f.b) GROUP BY ALL)
    SELECT t.run_id, t.step + 1, t.n0, t.a, t.b, t.d FROM t JOIN f ON f.run_id = t.run_id AND t.a NOT IN (f.a, f.b) AND t.b NOT IN (f.a, f.b)
    UNION ALL SELECT run_id, step + 1, n0, k, n0 + step, (dsum - dij) / 2 FROM k
    UNION ALL SELECT run_id, step + 1, n0, n0 + step, k, (dsum - dij) / 2 FROM k
    UNION ALL SELECT run_id, step + 1, n0, n0 + step, n0 + step, 0 FROM f)
), mt AS (SELECT *, sum(d) OVER (PARTITION BY run_id, step, a) AS ta, sum(d) OVER (PARTITION BY run_id, step, b) AS tb, count(*) OVER (PARTITION BY run_id, step, a) AS n FROM m
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY (n - 2) * d - ta - tb, a, b) AS rn FROM mt WHERE a < b) WHERE rn = 1
), link AS (
  SELECT run_id, a AS pos, CASE WHEN n > 2 THEN n0 + step END AS up, CASE WHEN n > 2 THEN (d + (ta - tb) / (n - 2)) / 2 ELSE d / 2 END AS weight FROM best
  UNION ALL SELECT run_id, b, CASE WHEN n > 2 THEN n0 + step END, CASE WHEN n > 2 THEN (d - (ta - tb) / (n - 2)) / 2 ELSE d / 2 END FROM best
), joined AS (
  SELECT l.run_id, coalesce(i.node, s.base + l.pos - s.n0) AS node_id, CASE WHEN l.up IS NULL THEN -1 ELSE s.base + l.up - s.n0 END AS parent_id, CASE WHEN i.node IS NULL THEN s.top + 1 + l.pos - s.n0 END AS level, l.weight
  FROM link l JOIN spec s USING (run_id) LEFT JOIN items i ON i.run_id = l.run_id AND i.pos = l.pos
  UNION ALL SELECT DISTINCT run_id, -1, NULL, s.top + s.n0 - 1, NULL FROM link JOIN spec s USING (run_id)
)"""

AT = "mrow AS (SELECT run_id, cell_id, max(idx) AS idx FROM c GROUP BY ALL)"
NJ_FULL = f"""WITH RECURSIVE {CELLS}, {AT}, items AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY level, ord) - 1 AS pos, cell_id AS node, idx FROM (SELECT run_id, cell_id, min(level) AS level, arg_min(ord, level) AS ord FROM c GROUP BY ALL) JOIN mrow USING (run_id, cell_id)
), spec AS (SELECT run_id, count(*) AS n0, max(node) + 2 AS base, 0 AS top FROM items GROUP BY run_id
), {JOINING}
SELECT j.run_id, node_id::BIGINT AS node_id, parent_id::BIGINT::VARCHAR AS parent_id, i.node::BIGINT::VARCHAR AS cell_id, coalesce(j.level, 0)::INT AS level, round(weight, 9) AS weight FROM joined j LEFT JOIN items i ON i.run_id = j.run_id AND i.node = j.node_id AND j.level IS NULL"""

#: The same with every sampled cell as an item of its own, though copies are one node.
NJ_SHARED = f"""{NJ_FULL[: NJ_FULL.index("items AS (")]}items AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY level, ord) - 1 AS pos, cell_id AS node, mrow.idx FROM c JOIN mrow USING (run_id, cell_id)
), spec AS (SELECT run_id, count(*) AS n0, max(node) + 2 AS base, 0 AS top FROM items GROUP BY run_id
), {JOINING}, graph AS (
  SELECT DISTINCT j.run_id, j.node_id::BIGINT AS node_id, j.parent_id::BIGINT AS parent_id, CASE WHEN j.level IS NULL THEN j.node_id::BIGINT END AS cell_id, coalesce(j.level, 0)::INT AS level, round(weight, 9) AS weight FROM joined j
)"""

#: Linking from the latest level on, a cell a step: w holds the layers as they are, with the copies that steps add.
LAYERED = f"""WITH RECURSIVE {CELLS}, {AT}, {DIST}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id, cell_id ORDER BY level DESC, ord) > 1 AS again FROM c), t AS (SELECT run_id, max(id_i) AS top FROM d GROUP BY ALL),
reg AS (SELECT run_id, level, ord, cell_id, genome, mrow.idx, CASE WHEN again THEN top + row_number() OVER (PARTITION BY run_id, again ORDER BY level DESC, ord) ELSE cell_id END AS node, max(level) OVER (PARTITION BY run_id) AS latest FROM s JOIN t USING (run_id) JOIN mrow USING (run_id, cell_id)
), start AS (
  SELECT run_id, latest, greatest(max(node), any_value(top)) + 1 AS fresh, list(layer ORDER BY level) AS layers
  FROM (SELECT run_id, level, latest, max(node) AS node, list(struct_pack(cell := cell_id, genome := genome, node := node, idx := idx) ORDER BY ord) AS layer FROM reg GROUP BY ALL) JOIN t USING (run_id) GROUP BY run_id, latest
), w AS (
  SELECT run_id, latest, latest AS lvl, 1::BIGINT AS k, fresh::BIGINT AS fresh, layers, NULL::BIGINT AS child, NULL::BIGINT AS parent, NULL::DOUBLE AS weight, NULL::BIGINT AS made_cell, NULL::BIGINT AS made_level FROM start
  UNION ALL (
    WITH y AS (SELECT *, layers[lvl + 1][k] AS y, layers[lvl] AS up FROM w WHERE lvl > 0),
    n AS (SELECT *, list_filter(up, lambda x: CASE WHEN x.idx = y.idx THEN 0 ELSE (x.idx * y.idx * 7 + x.idx + y.idx) % 6 + 1 END <= 4) AS near FROM y),
    p AS (SELECT *, list_filter(near, lambda x: x.cell = y.cell) AS same, list_filter(near, lambda x: len(list_filter(range(1, 11), lambda q: x.genome[q] = 0 AND y.genome[q] > 0)) = 0) AS possible FROM n),
    l AS (SELECT *, list_min(list_transform(possible, lambda x: CASE WHEN x.idx = y.idx THEN 0 ELSE (x.idx * y.idx * 7 + x.idx + y.idx) % 6 + 1 END)) AS low FROM p),
    o AS (SELECT *, CASE WHEN len(same) > 0 THEN same[1] ELSE list_filter(possible, lambda x: CASE WHEN x.idx = y.idx THEN 0 ELSE (x.idx * y.idx * 7 + x.idx + y.idx) % 6 + 1 END = low)[1] END AS chosen FROM l)
    SELECT run_id, latest, CASE WHEN y IS NULL THEN lvl - 1 ELSE lvl END, CASE WHEN y IS NULL THEN 1 ELSE k + 1 END, CASE WHEN y IS NOT NULL AND chosen IS NULL THEN fresh + 1 ELSE fresh END,
      CASE WHEN y IS NOT NULL AND chosen IS NULL THEN layers[1 : lvl - 1] || [up || [struct_pack(cell := y.cell, genome := y.genome, node := fresh, idx := y.idx)]] || layers[lvl + 1 :] ELSE layers END,
      y.node, CASE WHEN y IS NULL THEN NULL ELSE coalesce(chosen.node, fresh) END, CASE WHEN y IS NULL THEN NULL WHEN chosen IS NULL THEN 0 WHEN chosen.idx = y.idx THEN 0 ELSE (chosen.idx * y.idx * 7 + chosen.idx + y.idx) % 6 + 1 END,
      CASE WHEN y IS NOT NULL AND chosen IS NULL THEN y.cell END, CASE WHEN y IS NOT NULL AND chosen IS NULL THEN latest + 1 - lvl END FROM o)
), items AS (SELECT run_id, unnest(range(0, len(layers[1]))) AS pos, unnest(layers[1]).node AS node, unnest(layers[1]).idx AS idx FROM w WHERE lvl = 0
), spec AS (SELECT run_id, len(layers[1]) AS n0, fresh + 1 AS base, latest AS top FROM w WHERE lvl = 0
), {JOINING}, nodes AS (
  SELECT run_id, node, cell_id, latest - level AS level FROM reg UNION ALL SELECT run_id, parent, made_cell, made_level FROM w WHERE made_cell IS NOT NULL
), up AS (SELECT run_id, child AS node_id, parent AS parent_id, weight FROM w WHERE child IS NOT NULL UNION ALL SELECT run_id, node_id, parent_id, weight FROM joined WHERE level IS NULL
), layered AS (
  SELECT n.run_id, n.node::BIGINT AS node_id, parent_id::BIGINT AS parent_id, n.cell_id::BIGINT AS cell_id, n.level::INT AS level, round(weight, 9) AS weight FROM nodes n JOIN up ON up.run_id = n.run_id AND up.node_id = n.node
  UNION ALL SELECT run_id, node_id, parent_id, NULL, level, round(weight, 9) FROM joined WHERE level IS NOT NULL)"""

LAYOUT = f"""{LAYERED}, turned AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, level ORDER BY cell_id, node_id) - 1 AS rank, row_number() OVER (PARTITION BY run_id, cell_id IS NULL ORDER BY level) AS turn FROM layered
), many AS (SELECT run_id, count(DISTINCT level) AS levels FROM layered GROUP BY run_id)
SELECT run_id, node_id, CASE WHEN cell_id IS NOT NULL THEN rank::DOUBLE WHEN turn % 2 = 1 THEN 0.25::DOUBLE + 0.5::DOUBLE * (turn - 1) ELSE levels - (0.25::DOUBLE + 0.5::DOUBLE * (turn - 1)) END AS x, level AS y FROM turned JOIN many USING (run_id)"""

QUERIES = {
    "matrix_long": (matrix_long, f"WITH {CELLS}, {DIST} SELECT run_id, i::INT AS i, j::INT AS j, id_i, id_j, dist FROM d"),
    "matrix_text": (matrix_text, f"WITH {CELLS}, {DIST} SELECT run_id, i::INT AS i, id_i || ' ' || string_agg(dist::VARCHAR, ' ' ORDER BY j) AS value FROM d GROUP BY run_id, i, id_i"),
    "radius_candidates": (radius_candidates, f"WITH {CANDIDATES} SELECT run_id, level::INT AS level, y_ord::INT AS y_ord, x_ord::INT AS x_ord, dist FROM ca"),
    "zero_constraint": (zero_constraint, f"WITH {CANDIDATES} SELECT run_id, level::INT AS level, y_ord::INT AS y_ord, x_ord::INT AS x_ord FROM ca WHERE excluded AND NOT same"),
    "same_id_link": (same_id_link, f"WITH {CANDIDATES} SELECT run_id, level::INT AS level, y_ord::INT AS y_ord, x_ord::INT AS x_ord, y_cell FROM ca WHERE same"),
    "nearest_ancestor": (nearest_ancestor, f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, level, y_ord ORDER BY same DESC, CASE WHEN same THEN 0 ELSE dist END, x_ord) AS rn FROM ca WHERE same OR NOT excluded)
SELECT run_id, level::INT AS level, y_ord::INT AS y_ord, y_cell, x_ord::INT AS x_ord, x_cell, dist FROM r WHERE rn = 1"""),
    "layer_registration": (layer_registration, f"""WITH {CELLS}, {DIST}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id, cell_id ORDER BY level DESC, ord) > 1 AS again FROM c), t AS (SELECT run_id, max(id_i) AS top FROM d GROUP BY ALL)
SELECT run_id, level::INT AS level, ord::INT AS ord, CASE WHEN again THEN top + row_number() OVER (PARTITION BY run_id, again ORDER BY level DESC, ord) ELSE cell_id END AS node_id FROM s JOIN t USING (run_id)"""),
    "biopsy_cells": (biopsy_cells, f"WITH {CELLS} SELECT run_id, level::INT AS level, string_agg(cell_id::VARCHAR, ',' ORDER BY ord) AS cells FROM c GROUP BY run_id, level"),
    "biopsy_pooled": (biopsy_pooled, f"WITH {CELLS} SELECT run_id, 0 AS level, (row_number() OVER (PARTITION BY run_id ORDER BY level, ord) - 1)::INT AS ord, cell_id FROM c"),
    "biopsy_guard": (biopsy_guard, f"WITH {CELLS} SELECT run_id, count(*) AS n_cells FROM c WHERE level = 0 AND ord < run_no % 5 GROUP BY run_id HAVING count(*) >= 3"),
    "cell_lookup": (cell_lookup, f"WITH {CELLS} SELECT run_id, arg_min(idx, level * 10 + ord)::INT AS found FROM c WHERE cell_id = 7 - run_no % 5 GROUP BY run_id"),
    "visible_nodes": (visible_nodes, f"WITH {CELLS} SELECT run_id, idx AS node_id FROM c WHERE idx IN (0, 1) OR EXISTS (SELECT 1 FROM c s WHERE s.run_id = c.run_id AND s.level = 1 AND s.cell_id = c.cell_id)"),
    "nj_q_step": (nj_q_step, f"""WITH {CELLS}, {DIST}, t AS (SELECT run_id, i, sum(dist) AS t FROM d GROUP BY ALL), n AS (SELECT run_id, count(*) AS n FROM t GROUP BY ALL),
q AS (SELECT d.run_id, d.i, d.j, dist, a.t AS ti, b.t AS tj, n, (n - 2) * dist - a.t - b.t AS q FROM d JOIN t a USING (run_id, i) JOIN t b ON b.run_id = d.run_id AND b.i = d.j JOIN n ON n.run_id = d.run_id WHERE d.i < d.j),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY q, i, j) AS rn FROM q)
SELECT run_id, i::INT AS i, j::INT AS j, round(q, 9) AS q, dist, round((dist + (ti - tj) / (n - 2)) / 2, 9) AS limb_i, round((dist - (ti - tj) / (n - 2)) / 2, 9) AS limb_j FROM r WHERE rn = 1"""),
    "cnp_run_distance": (cnp_run_distance, f"WITH {PAIRS} SELECT p.o_orderkey, coalesce(sum((d <> 0 AND d <> before)::INT), 0)::INT AS runs FROM p LEFT JOIN s USING (o_orderkey) GROUP BY p.o_orderkey"),
    "cnp_breakpoint_bound": (cnp_breakpoint_bound, f"WITH {PAIRS} SELECT p.o_orderkey, ceil(coalesce(sum((d <> before)::INT + (last AND d <> 0)::INT), 0) / 2.0::DOUBLE)::INT AS bound FROM p LEFT JOIN s USING (o_orderkey) GROUP BY p.o_orderkey"),
    "cnp_event_distance": (cnp_event_distance, f"WITH RECURSIVE {ORDER_PAIRS}, g AS (SELECT u, v FROM p), {MEASURED} SELECT o_orderkey, dist, true AS exact FROM p JOIN far USING (u, v)"),
    "distance_matrix": (distance_matrix, f"{RUN_PAIRS} SELECT run_id, i::INT AS i, j::INT AS j, id_i, id_j, dist::DOUBLE AS dist, true AS exact FROM g JOIN far USING (u, v) WHERE i <= j UNION ALL SELECT run_id, j::INT, i::INT, id_j, id_i, dist::DOUBLE, true FROM g JOIN far USING (u, v) WHERE i < j"),
    "near_pairs": (near_pairs, NEAR_SQL),
    "near_ancestors": (near_ancestors, f"{NEAR_SQL} AND len(list_filter(range(1, 11), lambda k: u[k] = 0 AND v[k] > 0)) = 0"),
    "layered_within": (layered_within, None),
    "nj_full": (nj_full, NJ_FULL),
    "nj_shared": (nj_shared, f"{NJ_SHARED} SELECT run_id, node_id, parent_id::VARCHAR AS parent_id, cell_id::VARCHAR AS cell_id, level, weight FROM graph"),
    "shared_counts": (shared_counts, f"""{NJ_SHARED}, edges AS (SELECT DISTINCT run_id, node_id, parent_id FROM graph WHERE parent_id IS NOT NULL
), paths AS (SELECT DISTINCT run_id, cell_id, node_id, 1::BIGINT AS n FROM graph WHERE cell_id IS NOT NULL
  UNION ALL SELECT p.run_id, p.cell_id, e.parent_id, sum(p.n)::BIGINT FROM paths p JOIN edges e USING (run_id, node_id) GROUP BY ALL
) SELECT run_id, node_id, cell_id, sum(n)::BIGINT AS paths FROM paths GROUP BY ALL"""),
    "layered_full": (layered_full, f"{LAYERED} SELECT run_id, node_id, parent_id::VARCHAR AS parent_id, cell_id::VARCHAR AS cell_id, level, weight FROM layered"),
    "layered_layout": (layered_layout, LAYOUT),
    "biopsy_highlights": (biopsy_highlights, f"WITH {CELLS} SELECT n.run_id, n.idx AS node_id, b.level::INT AS level, {layout.PALETTE}[b.level % 19 + 1] AS colour FROM c n JOIN (SELECT DISTINCT run_id, cell_id, level FROM c) b USING (run_id, cell_id)"),
    "distance_labels": (distance_labels, f"WITH {CELLS}, {DIST} SELECT run_id, i::INT AS i, j::INT AS j, printf('Distance: %.2f', dist / 3) AS label FROM d WHERE i < j"),
    "experiment": (experiment, None),
}

"""Queries over stochastic steps: every draw is a hash, so SQL recomputes it."""

from __future__ import annotations

from pyspark.sql import functions as F

from phylospark.functions import profiles
from phylospark.functions.rng import poisson, uniform, uniform_int
from phylospark.functions.staging import stage
from phylospark.operators import biopsy, evolve
from phylospark.plans.locus_queries import GENOME, LENGTH, SCORE, WEIGHTS, genome, order_genomes
from phylospark.plans.tree_queries import table
from phylospark.sources.config import Model


def u(*parts: str) -> str:
    """The uniform draw in SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


#: Terms of Poisson distributions by mean: the quantile of a draw is the number of terms whose sum stays below it.
POISSON = "terms AS (SELECT lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS total FROM lams UNION ALL SELECT lam, k + 1, p * lam / (k + 1), total + p * lam / (k + 1) FROM terms WHERE k < ceil(lam + 6.5 * sqrt(lam) + 12) - 1)"


def draw_of(model: str, parameter: str) -> Model:
    return Model(1, model, parameter, 0.1, 0.5, 1.0, 0.5, 0.3)


def offspring(model: str, parameter: str):
    def query(spark, sf_dir):
        k = evolve.offspring(draw_of(model, parameter), uniform(7, F.col("o_orderkey"), "offspring"), F.col("g"), F.lit(WEIGHTS))
        return order_genomes(spark, sf_dir).select("o_orderkey", k.cast("int").alias("drawn"), (k + 1).cast("int").alias("children"))

    return query


OFFSPRING_U = u("'7'", "o_orderkey", "'offspring'")


def event_draw(spark, sf_dir):
    """Which loci of an order's profile draw an event, how far it reaches, its type and its copies."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))).alias("pos"))
    name = lambda what: uniform(3, key, F.col("pos"), what)
    rows = rows.where(name("event") < 0.1)
    end = F.when(name("multiple") < 0.3, uniform_int(name("end"), F.col("pos"), LENGTH - 1)).otherwise(F.col("pos"))
    gain = name("type") < 0.5
    return rows.select("o_orderkey", "pos", end.cast("int").alias("pos_end"), F.when(gain, "duplication").otherwise("loss").alias("type"), F.when(gain, poisson(name("copies"), 1.0) + 1).otherwise(-1).cast("int").alias("copies"))


def clamped_scan(spark, sf_dir):
    """Two copies changed by an order's lines in turn, never below 0: what is left after each line, by running sums and minima."""
    from pyspark.sql import Window

    change = F.when(F.col("l_linenumber") % 3 == 0, 2).otherwise(-1)
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(change).alias("change"))
    rows = rows.withColumn("s", F.sum("change").over(own)).withColumn("low", F.min("s").over(own))
    return rows.select("l_orderkey", "l_linenumber", (F.col("s") + F.greatest(F.lit(2), -F.col("low"))).alias("copies"))


MODEL = Model(1, "constant", "2", 0.1, 0.5, 1.0, 0.5, 0.3, genome_length=LENGTH, initial_copies=2, crucial=True)
LOCI = evolve.Genome([2] * LENGTH, [0.1] * LENGTH, [0.3] * LENGTH, [0.5] * LENGTH, [1.0] * LENGTH, [0.0] * LENGTH, [i in (0, 5) for i in range(LENGTH)])


def parents(spark, sf_dir):
    """Suppliers as cells; nations are runs."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("run_id"), F.lit(11).alias("seed"), place.cast("long").alias("node_id"), place.cast("long").alias("cell_id"), genome(F.col("s_suppkey"), F.col("s_nationkey")).alias("genome"))


def evolve_step(spark, sf_dir):
    """One whole generation: offspring, events, losses of crucial loci, first of each genome, numbers and cells."""
    own = stage(parents(spark, sf_dir), "parents")
    ids = own.groupBy("run_id").agg(F.count(F.lit(1)).alias("next_id"))
    rows = evolve.next_generation(own, ids, MODEL, LOCI, 1)
    return rows.select("run_id", "node_id", "parent_id", "cell_id", F.array_join(F.transform("genome", lambda c: c.cast("string")), ",").alias("genome"), profiles.render_events(F.col("events")).alias("events"))


def d(what: str) -> str:
    return u("'11'", "run_id", "'1'", "node_id", "child", "pos", f"'{what}'")


STEP = f"""WITH RECURSIVE lams AS (SELECT 1.0::DOUBLE AS lam), {POISSON}, pa AS (
  SELECT s_nationkey::VARCHAR AS run_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS node_id, list_transform(range(0, {LENGTH}), lambda i: ((s_suppkey * (i + 3) + s_nationkey) % 5)::INT) AS g FROM supplier
), ch AS (SELECT run_id, node_id, g, child FROM pa, range(0, 3) c(child)
), ev AS (
  SELECT *, CASE WHEN {d('multiple')} < 0.3 THEN pos + floor({d('end')} * ({LENGTH} - pos))::INT ELSE pos END AS pos_end, {d('type')} < 0.5 AS gain, {d('copies')} AS uc
  FROM (SELECT run_id, node_id, child, pos FROM ch, range(0, {LENGTH}) p(pos)) WHERE {d('event')} < 0.1
), ec AS (SELECT *, CASE WHEN gain THEN (SELECT count(*) FROM terms WHERE total < uc)::INT + 1 ELSE -1 END AS n FROM ev
), st AS (
  SELECT e.run_id, e.node_id, e.child, e.pos AS k, q.loc, c.g[q.loc + 1] AS g0, sum(n) OVER w AS s, e.pos IN (0, 5) AS crucial
  FROM ec e JOIN ch c USING (run_id, node_id, child), range(0, {LENGTH}) q(loc) WHERE q.loc BETWEEN e.pos AND e.pos_end WINDOW w AS (PARTITION BY e.run_id, e.node_id, e.child, q.loc ORDER BY e.pos)
), sc AS (SELECT *, s + greatest(g0, -min(s) OVER (PARTITION BY run_id, node_id, child, loc ORDER BY k)) AS gk FROM st
), dead AS (SELECT DISTINCT run_id, node_id, child FROM sc WHERE crucial AND gk = 0
), fin AS (SELECT run_id, node_id, child, loc, arg_max(gk, k) AS c FROM sc GROUP BY ALL
), gen AS (
  SELECT c.run_id, c.node_id, c.child, string_agg(coalesce(f.c, c.g[q.loc + 1])::BIGINT::VARCHAR, ',' ORDER BY q.loc) AS genome
  FROM (SELECT ch.*, unnest(range(0, {LENGTH})) AS loc0 FROM ch) c JOIN range(0, {LENGTH}) q(loc) ON q.loc = c.loc0 LEFT JOIN fin f ON f.run_id = c.run_id AND f.node_id = c.node_id AND f.child = c.child AND f.loc = q.loc GROUP BY c.run_id, c.node_id, c.child
), txt AS (SELECT run_id, node_id, child, string_agg(CASE WHEN gain THEN 'duplication' ELSE 'loss' END || '(pos=' || pos || CASE WHEN pos_end <> pos THEN '-' || pos_end ELSE '' END || ', copies=' || n || ')', ';' ORDER BY pos) AS events FROM ec GROUP BY ALL
), kept AS (
  SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY run_id, genome ORDER BY node_id, child) AS rn FROM gen g ANTI JOIN dead USING (run_id, node_id, child)) WHERE rn = 1
), num AS (SELECT k.*, coalesce(events, '') AS events, row_number() OVER (PARTITION BY run_id ORDER BY node_id, child) - 1 + (SELECT count(*) FROM pa WHERE pa.run_id = k.run_id) AS id FROM kept k LEFT JOIN txt USING (run_id, node_id, child))
SELECT run_id, id::BIGINT AS node_id, node_id::BIGINT AS parent_id, CASE WHEN events <> '' THEN id ELSE node_id END::BIGINT AS cell_id, genome, events FROM num"""


def biopsy_sample(spark, sf_dir):
    """A third of each nation's customers, drawn without replacement."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("run_id"), (F.col("c_custkey") % 3).cast("int").alias("generation"), F.col("c_custkey").alias("node_id"), F.col("c_custkey").alias("cell_id"), F.array(F.lit(1)).alias("genome"))
    return biopsy.sample(rows, [0, 2], fraction=0.3333, seed=5).select("run_id", "level", "ord", "cell_id")


def biopsy_sample_size(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("run_id"), F.lit(4).alias("generation"), F.col("c_custkey").alias("node_id"), F.col("c_custkey").alias("cell_id"), F.array(F.lit(1)).alias("genome"))
    return biopsy.sample(rows, [4], size=5, seed=5).select("run_id", "level", "ord", "cell_id")


def event_string_render(spark, sf_dir):
    return event_texts(spark, sf_dir).select("l_orderkey", profiles.render_events(F.col("events")).alias("text"))


def event_texts(spark, sf_dir):
    one = F.struct(F.col("l_linenumber").cast("int").alias("pos_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).cast("int").alias("pos_end"), F.when(F.col("l_returnflag") == "R", "loss").otherwise("duplication").alias("type"), F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("l_quantity").cast("int") % 4 + 1).alias("copies"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("events"))


def event_string_parse(spark, sf_dir):
    rows = event_string_render(spark, sf_dir).select("l_orderkey", F.inline(profiles.parse_events(F.col("text"))))
    return rows.groupBy("l_orderkey", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("pos_start").alias("starts"), F.sum("pos_end").alias("ends"), F.sum("copies").alias("copies"))


LINES = """e AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + l_quantity::INT % 3 AS b, CASE WHEN l_returnflag = 'R' THEN 'loss' ELSE 'duplication' END AS type, CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_quantity::INT % 4 + 1 END AS n FROM lineitem)"""

_poisson = lambda lams, of: f"WITH RECURSIVE o AS (SELECT o_orderkey, {OFFSPRING_U} AS u, {GENOME} AS g FROM orders), m AS (SELECT o_orderkey, u, {of} AS lam FROM o), lams AS ({lams}), {POISSON}, k AS (SELECT o_orderkey, count(t.k) AS drawn FROM m LEFT JOIN terms t ON t.lam = m.lam AND t.total < m.u GROUP BY o_orderkey) SELECT o_orderkey, drawn::INT AS drawn, (drawn + 1)::INT AS children FROM k"

QUERIES = {
    "offspring_constant": (offspring("constant", "3"), "SELECT o_orderkey, 3 AS drawn, 4 AS children FROM orders"),
    "offspring_uniform": (offspring("uniform_range", "1,4"), f"SELECT o_orderkey, (1 + floor({OFFSPRING_U} * 4))::INT AS drawn, (2 + floor({OFFSPRING_U} * 4))::INT AS children FROM orders"),
    "offspring_poisson": (offspring("poisson", "2.5"), _poisson("SELECT 2.5::DOUBLE AS lam", "2.5::DOUBLE")),
    "offspring_fitness": (offspring("fitness", "2"), _poisson("SELECT DISTINCT lam FROM m", f"2.0::DOUBLE / (1 + exp(-({SCORE})))")),
    "event_draw": (event_draw, f"""WITH RECURSIVE lams AS (SELECT 1.0::DOUBLE AS lam), {POISSON}, e AS (SELECT o_orderkey, pos FROM orders, range(0, {LENGTH}) p(pos) WHERE {u("'3'", "o_orderkey", "pos", "'event'")} < 0.1),
f AS (SELECT *, {u("'3'", "o_orderkey", "pos", "'type'")} < 0.5 AS gain, {u("'3'", "o_orderkey", "pos", "'copies'")} AS uc FROM e)
SELECT o_orderkey, pos::INT AS pos, CASE WHEN {u("'3'", "o_orderkey", "pos", "'multiple'")} < 0.3 THEN pos + floor({u("'3'", "o_orderkey", "pos", "'end'")} * ({LENGTH} - pos)) ELSE pos END::INT AS pos_end,
  CASE WHEN gain THEN 'duplication' ELSE 'loss' END AS type, CASE WHEN gain THEN (SELECT count(*) FROM terms WHERE total < uc) + 1 ELSE -1 END::INT AS copies FROM f"""),
    "clamped_scan": (clamped_scan, """WITH c AS (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE -1 END) AS change FROM lineitem GROUP BY ALL), s AS (SELECT *, sum(change) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM c)
SELECT l_orderkey, l_linenumber, (s + greatest(2, -min(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)))::BIGINT AS copies FROM s"""),
    "evolve_step": (evolve_step, STEP),
    "biopsy_sample": (biopsy_sample, f"""WITH r AS (SELECT c_nationkey::VARCHAR AS run_id, c_custkey % 3 AS gen, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY {u("'5'", "c_nationkey", "c_custkey % 3", "c_custkey", "'biopsy'")}, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 3) AS n FROM customer)
SELECT run_id, CASE gen WHEN 0 THEN 0 ELSE 1 END AS level, (rn - 1)::INT AS ord, c_custkey AS cell_id FROM r WHERE gen IN (0, 2) AND rn <= floor(n * 0.3333::DOUBLE)"""),
    "biopsy_sample_size": (biopsy_sample_size, f"""SELECT c_nationkey::VARCHAR AS run_id, 0 AS level, (rn - 1)::INT AS ord, c_custkey AS cell_id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {u("'5'", "c_nationkey", "'4'", "c_custkey", "'biopsy'")}, c_custkey) AS rn FROM customer) WHERE rn <= 5"""),
    "event_string_render": (event_string_render, f"WITH {LINES} SELECT l_orderkey, string_agg(type || '(pos=' || a || CASE WHEN a = b THEN '' ELSE '-' || b END || ', copies=' || n || ')', ';' ORDER BY a, b, type, n) AS text FROM e GROUP BY l_orderkey"),
    "event_string_parse": (event_string_parse, f"WITH {LINES} SELECT l_orderkey, type, count(*) AS n, sum(a)::BIGINT AS starts, sum(b)::BIGINT AS ends, sum(n)::BIGINT AS copies FROM e GROUP BY l_orderkey, type"),
}

"""Queries over loci: parts stand for loci, their brand for the chromosome."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phylospark.functions import profiles
from phylospark.plans.tree_queries import table
from phylospark.sources import loci
from phylospark.sources.config import Model

MODEL = Model(2, "constant", "2", 0.02, 0.5, 1.0, 0.5, 0.01, telomeres=True, telomere_share=0.1, telomere_instability=0.1)


def texts(spark, sf_dir):
    """(p_partkey, p_brand, Parameters): parameter texts with absent, repeated and unknown keys and trailing semicolons."""
    k, two = F.col("p_partkey"), F.lpad(F.col("p_size").cast("string"), 2, "0")
    text = F.concat(
        F.lit("CN="), (k % 5).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(";EVENT_PROB=0."), two)).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(";TELOMERIC_INSTABILITY=0.5;FITNESS_WEIGHT=-0."), two)).otherwise(""),
        F.when(k % 7 == 0, ";DUPLICATION_PROB=0.9;").otherwise(""), F.when(k % 11 == 0, ";CN=2.9;OTHER=1;plain").otherwise(""), F.when(k % 13 == 0, ";CRUCIAL=1").otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", text.alias("Parameters"))


def loci_table(spark, sf_dir):
    rows = loci.with_defaults(texts(spark, sf_dir)).withColumn("chromosome", F.col("p_brand"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)


LOCI = """l AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE p_partkey % 5 END::INT AS cn, CASE WHEN p_partkey % 2 = 0 THEN p_size / 100.0::DOUBLE END AS event_prob,
  CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE END AS telomeric_instability, CASE WHEN p_partkey % 3 = 0 THEN -p_size / 100.0::DOUBLE ELSE 0 END AS fitness_weight, CASE WHEN p_partkey % 7 = 0 THEN 0.9::DOUBLE END AS duplication_prob,
  CASE WHEN p_partkey % 13 = 0 THEN 1.0::DOUBLE ELSE 0 END AS crucial, row_number() OVER w AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
f AS (SELECT *, coalesce(event_prob, 0.02) AS p, coalesce(telomeric_instability, CASE WHEN rn <= floor(n * 0.1::DOUBLE) OR rn > n - floor(n * 0.1::DOUBLE) THEN 0.1::DOUBLE ELSE 0 END) AS telomere FROM l)"""


def kv_params_parse(spark, sf_dir):
    return loci_table(spark, sf_dir).select("p_partkey", "cn", *(F.round(c, 9).alias(c) for c in ("event_prob", "telomeric_instability", "fitness_weight", "duplication_prob", "crucial")))


def param_resolve(spark, sf_dir):
    rows = loci.resolve(loci_table(spark, sf_dir), MODEL)
    return rows.select("p_partkey", *(F.round(c, 9).alias(c) for c in ("event_prob", "duplication_prob", "duplication_multiplicity", "loss_prob", "multiple_prob")))


def telomere_factor(spark, sf_dir):
    rows = loci.telomere_factor(loci_table(spark, sf_dir), MODEL.telomere_share, MODEL.telomere_instability)
    return rows.select("p_partkey", F.round("telomere", 9).alias("telomere"))


def event_prob_eff(spark, sf_dir):
    return loci.resolve(loci_table(spark, sf_dir), MODEL).select("p_partkey", F.round("p_event", 9).alias("p_event"))


LENGTH = 10


def genome(key, shift):
    """A profile made of an order's keys."""
    return F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda i: ((key * (i + 3) + shift) % 5).cast("int"))


WEIGHTS = [0.1 * (i - 4) for i in range(LENGTH)]
GENOME = f"list_transform(range(0, {LENGTH}), lambda i: ((o_orderkey * (i + 3) + o_custkey) % 5)::INT)"
SCORE = f"list_sum(list_transform(range(1, {LENGTH + 1}), lambda i: {WEIGHTS}[i] * (g[i] - 1)))"


def bed_like_rows(spark, sf_dir):
    return loci_table(spark, sf_dir).select("p_partkey", F.concat(F.lit("CN="), F.col("cn")).alias("Parameters"))


def order_genomes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", genome(F.col("o_orderkey"), F.col("o_custkey")).alias("g"))


def fitness_lambda(spark, sf_dir):
    w = F.lit(WEIGHTS)
    return order_genomes(spark, sf_dir).select("o_orderkey", F.round(profiles.fitness_mean(F.col("g"), w, 4.0), 9).alias("mean_offspring"), F.round(profiles.mean_weighted_copies(F.col("g"), w), 9).alias("fitness"))


def cnp_text_format(spark, sf_dir):
    from phylospark.sources.profiles import profile_lines

    rows = order_genomes(spark, sf_dir).select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("cell_id"), F.col("g").alias("genome"))
    return profile_lines(rows)


def boolean_flags(spark, sf_dir):
    from phylospark.sources.config import is_true

    text = F.element_at(F.lit(["True", "true", "FALSE", "yes"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", is_true(text).alias("flag"))


QUERIES = {
    "kv_params_parse": (kv_params_parse, f"WITH {LOCI} SELECT p_partkey, cn, round(event_prob, 9) AS event_prob, telomeric_instability, round(fitness_weight, 9) AS fitness_weight, duplication_prob, crucial FROM l"),
    "param_resolve": (param_resolve, f"WITH {LOCI} SELECT p_partkey, round(p, 9) AS event_prob, coalesce(duplication_prob, 0.5) AS duplication_prob, 1.0::DOUBLE AS duplication_multiplicity, 0.5::DOUBLE AS loss_prob, 0.01::DOUBLE AS multiple_prob FROM f"),
    "telomere_factor": (telomere_factor, f"WITH {LOCI} SELECT p_partkey, round(telomere, 9) AS telomere FROM f"),
    "event_prob_eff": (event_prob_eff, f"WITH {LOCI} SELECT p_partkey, round(least(1.0::DOUBLE, p + telomere), 9) AS p_event FROM f"),
    "fitness_lambda": (fitness_lambda, f"WITH o AS (SELECT o_orderkey, {GENOME} AS g FROM orders) SELECT o_orderkey, round(4.0::DOUBLE / (1 + exp(-({SCORE}))), 9) AS mean_offspring, round(list_sum(list_transform(range(1, {LENGTH + 1}), lambda i: {WEIGHTS}[i] * g[i])) / {LENGTH}, 9) + 0.0 AS fitness FROM o"),
    "cnp_text_format": (cnp_text_format, f"SELECT o_orderkey AS ord, '>' || o_custkey || chr(10) || array_to_string({GENOME}, ',') AS value FROM orders"),
    "bed_like_rows": (bed_like_rows, f"WITH {LOCI} SELECT p_partkey, 'CN=' || cn AS \"Parameters\" FROM l"),
    "boolean_flags": (boolean_flags, "SELECT o_orderkey, lower(['True', 'true', 'FALSE', 'yes'][o_orderkey % 4 + 1]) = 'true' AS flag FROM orders"),
}

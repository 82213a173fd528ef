"""Summaries of results: bins, ordered labels, box statistics and timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions.staging import stage

#: Values of a group that one aggregate may hold.
HELD = 100_000
#: Parts into which a range of values is cut in each round.
PARTS = 4096
#: Groups that are sent to every task at most.
MAX_SENT = 10_000
MOST = 1.7976931348623157e308  # the largest double
# The bins of tree sizes and the order of labels.
SIZE_BINS = ((0, 1000, "<1000"), (1000, 1500, "1000–1500"), (1500, 2000, "1500–2000"), (2000, 1_000_000, ">2000"))
TREE_LABELS = ("6L-2B", "8L-2B", "8L-3B", "10L-2B", "10L-3B", "14L-2B")


def binned(value: Column, bins=SIZE_BINS) -> Column:
    """The label of the bin that holds the value; bins are open below and closed above, and values outside have none."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bins):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def tree_label(levels: Column, biopsies: Column) -> Column:
    return F.format_string("%dL-%dB", levels, biopsies)


def sample_label(size: Column, percentile: Column) -> Column:
    return F.format_string("%.1f | %s", size, percentile.cast("string"))


def label_rank(label: Column, order=TREE_LABELS) -> Column:
    """The place of a label in a stated order; null for others."""
    place = F.array_position(F.lit(list(order)), label)
    return F.when(place > 0, place).cast("int")


def sample_rank(label: Column) -> Column:
    """The key by which sample labels sort: both numbers."""
    parts = F.split(label, r" \| ")
    return F.struct(parts[0].cast("double").alias("size"), parts[1].cast("double").alias("percentile"))


def facet_title(label: Column) -> Column:
    # The pattern of a label and the wording of a title.
    return F.regexp_replace(F.concat(F.lit("Tree "), label), r"Tree ([0-9]*)L-([0-9]*)B", "Trees: $1 levels | $2 biopsies")


def labelled(results: DataFrame) -> DataFrame:
    """Results with the labels that plots group by."""
    rows = results.withColumns({"size_bin": binned(F.col("GenTreeSize")), "tree_biopsies": tree_label(F.col("TreeSize"), F.col("NumBiopsies")), "sample": sample_label(F.col("biopsy_size"), F.col("RPercentile"))})
    rank = label_rank(F.col("tree_biopsies"))
    return rows.withColumn("tree_rank", rank).withColumn("tree_biopsies", F.when(rank.isNotNull(), F.col("tree_biopsies")))


def same_group(by, left: str, right: str) -> Column:
    """Rows of one group; a null is a key like any other."""
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by], F.lit(True))


def sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(MAX_SENT + 1).count() <= MAX_SENT else rows


def place_in(v: Column) -> Column:
    """The part of the range from lo to hi that holds v, increasing with v; lo and hi are in different ones unless they are equal. Parts are alike in
    magnitude while the range holds zero or several powers of two, and alike in length from then on, so a handful of rounds is enough for any doubles."""
    lo, hi = F.greatest("lo", F.lit(-MOST)), F.least("hi", F.lit(MOST))
    spread = lambda low, x, high: F.floor((x - low) / F.when(high > low, high - low) * PARTS)
    size = lambda x: F.signum(x) * F.coalesce(F.ln(F.when(x != 0, F.abs(x))) + 746, F.lit(0.0))  # the least double has -744.4
    near = ((lo > 0) & (hi / 4 <= lo)) | ((hi < 0) & (lo / 4 >= hi))
    part = F.when(near, spread(lo, v, hi)).otherwise(spread(size(lo), size(v), size(hi)))
    return F.when(v < -MOST, -1).when(v > MOST, PARTS + 1).otherwise(F.coalesce(part, F.lit(0)))


def ranked(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, k, found): the value of each wanted rank (g, k, rank from 0, lo, hi) among a group's values (g, v), which lie from lo to hi.

    Ranges of values are cut into parts with their counts; a rank falls into one part, whose least and largest value are the next range, until these are equal.
    A round reads the values once and shuffles counts, at most PARTS + 3 a range and task."""
    done = None
    while True:
        wanted = stage(wanted.select("g", "k", "rank", "lo", "hi"), "wanted")
        ended = wanted.where("lo = hi").select("g", "k", F.col("lo").alias("found"))
        done = ended if done is None else done.unionByName(ended)
        wanted = wanted.where("lo < hi")
        if wanted.isEmpty():
            return done
        ranges = wanted.select("g", "lo", "hi").distinct()  # apart from each other: a value is in one at most
        inside = values.join(sent(ranges), "g").where("v >= lo AND v <= hi").withColumn("part", place_in(F.col("v")))
        parts = inside.groupBy("g", "lo", "hi", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("part")) - F.col("n")
        found = wanted.join(parts.withColumn("before", before), ["g", "lo", "hi"]).where("before <= rank AND rank < before + n")
        wanted = found.select("g", "k", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))


def quantiles(rows: DataFrame, value: str, by, shares=(0.25, 0.5, 0.75), held: int = HELD) -> DataFrame:
    """(by, q): exact quantiles of each group, by linear interpolation between the values next to them; null where a group has none. Nulls and NaN have
    no place. Groups of up to held values are one aggregate each; those of larger ones come from ``ranked``, which holds none of them."""
    v = F.col(value).cast("double")
    rows = rows.select(*by, F.when(~F.isnan(v), v).alias("v"))
    held_at_once = lambda rows: rows.groupBy(*by).agg(F.percentile("v", F.lit(list(shares))).alias("q"))
    sizes = rows.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") > held)
    sizes = stage(sizes.withColumn("g", F.monotonically_increasing_id()), "sizes")
    if sizes.isEmpty():
        return held_at_once(rows)
    large, on = sent(sizes), same_group(by, "r", "s")
    values = stage(rows.alias("r").join(large.alias("s"), on).where("r.v IS NOT NULL").select("s.g", "r.v"), "values")
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ends = [F.struct(F.lit(2 * i + e).alias("k"), f(at(p)).cast("long").alias("rank")) for i, p in enumerate(shares) for e, f in enumerate((F.floor, F.ceil))]
    wanted = sizes.select("g", "lo", "hi", F.explode(F.array(*ends)).alias("w")).select("g", "lo", "hi", "w.k", "w.rank")
    found = ranked(values, wanted).groupBy("g").agg(*(F.max(F.when(F.col("k") == k, F.col("found"))).alias(f"v{k}") for k in range(2 * len(shares))))

    def between(i: int, p: float) -> Column:
        low, high, spot = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}"), at(p)
        return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    found = sizes.join(found, "g").select(*by, F.array(*(between(i, p) for i, p in enumerate(shares))).alias("q"))
    if not by:  # one group, and it is large
        return found
    return found.unionByName(held_at_once(rows.alias("r").join(large.alias("s"), on, "left_anti")))


def boxed(rows: DataFrame, value: str, *by: str, reach: float = 1.5, held: int = HELD) -> DataFrame:
    """The rows with q1, median and q3 of their group, and inside: the value is within reach times the quartile distance of the quartiles."""
    boxes = quantiles(rows, value, by, held=held).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    far = reach * (F.col("q3") - F.col("q1"))
    joined = rows.alias("r").join(boxes.alias("s"), same_group(by, "r", "s")).select("r.*", "s.q1", "s.median", "s.q3")
    return joined.withColumn("inside", (F.col(value) >= F.col("q1") - far) & (F.col(value) <= F.col("q3") + far))


def box_statistics(rows: DataFrame, value: str, *by: str, reach: float = 1.5, held: int = HELD) -> DataFrame:
    """(by, n, low, q1, median, q3, high, n_outliers): whiskers end at the last values within reach times the quartile distance. Quartiles are joined back by
    group, so no group is gathered, and none above held values is kept in an aggregate."""
    keyed, v = boxed(rows, value, *by, reach=reach, held=held), F.col(value)
    return keyed.groupBy(*by, "q1", "median", "q3").agg(F.count(value).alias("n"), F.min(F.when(F.col("inside"), v)).alias("low"), F.max(F.when(F.col("inside"), v)).alias("high"), F.sum(F.when(~F.col("inside"), 1).otherwise(0)).alias("n_outliers"))


def outliers(rows: DataFrame, value: str, *by: str, reach: float = 1.5, held: int = HELD) -> DataFrame:
    """The rows beyond the whiskers of their group, with high: whether they are above."""
    keyed = boxed(rows, value, *by, reach=reach, held=held).where("NOT inside")
    return keyed.withColumn("high", F.col(value) > F.col("q3")).drop("q1", "median", "q3", "inside")


def mean_by_label(rows: DataFrame, label: str, value: str) -> DataFrame:
    """The mean of a timer's durations by label."""
    return rows.groupBy(label).agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("n"))

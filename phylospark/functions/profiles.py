"""Expressions over copy-number profiles, arrays of whole numbers with one value for each locus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENTS = "array<struct<pos_start: int, pos_end: int, type: string, copies: int>>"


def regains(ancestor: Column, descendant: Column) -> Column:
    """Whether a locus that the ancestor lost is present again: such an ancestor is excluded."""
    return F.exists(F.zip_with(ancestor, descendant, lambda a, b: (a == 0) & (b > 0)), lambda v: v)


def weighted_score(genome: Column, weights: Column) -> Column:
    """Sum of weight times (copies - 1)."""
    terms = F.zip_with(genome, weights, lambda c, w: w * (c - 1))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def fitness_mean(genome: Column, weights: Column, most, alpha: float = 1.0) -> Column:
    """Expected offspring: a logistic curve of the score between 0 and most, in the form that large scores don't overflow."""
    most = most if isinstance(most, Column) else F.lit(float(most))
    return most / (1 + F.exp(-alpha * weighted_score(genome, weights)))


def mean_weighted_copies(genome: Column, weights: Column) -> Column:
    """Sum of weight times copies over the number of loci."""
    return F.aggregate(F.zip_with(genome, weights, lambda c, w: w * c), F.lit(0.0), lambda a, x: a + x) / F.size(genome)


def apply_events(genome: Column, events: Column, crucial: Column | None = None, everywhere: bool = False, absorbing: bool = False) -> Column:
    """Struct (genome, dead) after the events in order: copies of the loci of an event change, never below 0. With crucial (an
    array of flags), an event whose first locus is crucial kills where a locus it touches reaches 0, even if a later one restores it;
    everywhere judges each such locus by its own flag. With absorbing, a locus at 0 stays there."""
    start = F.struct(genome.alias("genome"), F.lit(False).alias("dead"))

    def step(s: Column, e: Column) -> Column:
        touched = lambda pos: (pos >= e["pos_start"]) & (pos <= e["pos_end"])
        changes = (lambda c, pos: touched(pos) & (c > 0)) if absorbing else (lambda c, pos: touched(pos))
        after = F.transform(s["genome"], lambda c, pos: F.when(changes(c, pos), F.greatest(F.lit(0), c + e["copies"])).otherwise(c))
        dead = s["dead"]
        if crucial is not None:
            part = lambda values: F.slice(values, e["pos_start"] + 1, e["pos_end"] - e["pos_start"] + 1)
            if everywhere:
                dead = dead | F.exists(F.zip_with(part(after), part(crucial), lambda c, flag: (c == 0) & flag), lambda x: x)
            else:
                dead = dead | (F.get(crucial, e["pos_start"]) & F.exists(part(after), lambda c: c == 0))
        return F.struct(after.alias("genome"), dead.alias("dead"))

    return F.aggregate(events, start, step)


def render_events(events: Column) -> Column:
    """type(pos=i or i-j, copies=n), joined by semicolons."""

    def one(e: Column) -> Column:
        place = F.when(e["pos_start"] == e["pos_end"], e["pos_start"].cast("string")).otherwise(F.concat_ws("-", e["pos_start"], e["pos_end"]))
        return F.concat(e["type"], F.lit("(pos="), place, F.lit(", copies="), e["copies"].cast("string"), F.lit(")"))

    return F.array_join(F.transform(events, one), ";")


def parse_events(text: Column) -> Column:
    """The events of a rendered text; an empty text has none."""
    pattern = r"(\w+)\(pos=(\d+)(?:-(\d+))?, copies=(-?\d+)\)"

    def one(s: Column) -> Column:
        part = lambda k: F.regexp_extract(s, pattern, k)
        last = F.when(part(3) == "", part(2)).otherwise(part(3))
        return F.struct(part(2).cast("int").alias("pos_start"), last.cast("int").alias("pos_end"), part(1).alias("type"), part(4).cast("int").alias("copies"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), one)


def flat_runs(u: Column, v: Column, drop_lost: bool = True) -> Column:
    """Runs of equal nonzero change from u to v, an upper bound of the interval events between them; loci lost in u are left out."""
    pairs = F.arrays_zip(u.alias("u"), v.alias("v"))
    kept = F.filter(pairs, lambda p: p["u"] != 0) if drop_lost else pairs
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(s: Column, p: Column) -> Column:
        d = p["v"] - p["u"]
        return F.struct((s["n"] + F.when((d != 0) & (d != s["last"]), 1).otherwise(0)).alias("n"), d.alias("last"))

    return F.aggregate(kept, start, step, lambda s: s["n"])


def breakpoint_bound(u: Column, v: Column) -> Column:
    """Half the places where the change from u to v steps, rounded up: a lower bound of the interval events."""
    kept = F.filter(F.arrays_zip(u.alias("u"), v.alias("v")), lambda p: p["u"] != 0)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(s: Column, p: Column) -> Column:
        d = p["v"] - p["u"]
        return F.struct((s["n"] + F.when(d != s["last"], 1).otherwise(0)).alias("n"), d.alias("last"))

    return F.aggregate(kept, start, step, lambda s: F.ceil((s["n"] + F.when(s["last"] != 0, 1).otherwise(0)) / 2).cast("int"))


def multiset_distance(left: Column, right: Column) -> Column:
    """1 less the sum of least counts over the sum of greatest, for arrays of (label, cnt) sorted or not; 0 if both are empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, e: s + e["cnt"])
    counts = F.map_from_entries(right)
    common = F.aggregate(left, F.lit(0).cast("long"), lambda s, e: s + F.least(e["cnt"], F.coalesce(F.try_element_at(counts, e["label"]), F.lit(0).cast("long"))))
    union = total(left) + total(right) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - common / union)

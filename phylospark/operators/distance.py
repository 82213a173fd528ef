"""Distances between profiles: the least number of interval additions that turn one into the other.

Loci that the first profile lost are left out. The changes of the rest step at breakpoints that sum to zero; an interval addition
joins breakpoints, and k of them need k-1 additions if they sum to zero. So the distance is the number of breakpoints less the
largest number of disjoint groups that sum to zero. Opposite breakpoints pair off first, which loses nothing; ``Search`` finds the groups
of the rest.

Finding them is hard in general. A search takes at most ``STEPS`` steps; where it ends there, the distance is known between two
bounds only: ``bounds`` gives both, ``distance`` the upper one (so many additions do suffice), and every table of distances has a column
``exact``.

``matrix`` gives all pairs of a run; ``near`` gives the pairs within a radius without making the others: half the breakpoints, rounded up,
are a lower bound of the distance, and the breakpoints between two profiles are the places where their steps differ, so the search is
one for step vectors that differ in few places (a join on rare steps).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from phylospark.functions.staging import stage

#: Steps of one search, and profiles of a block: a pair of blocks is one task's share.
STEPS, BLOCK = 1_000_000, 256
#: Group sizes up to DEEPEST are told apart by tables of sums, for values up to WIDEST; UNITS is a multiple of all these sizes.
DEEPEST, WIDEST, UNITS = 7, 1 << 12, 420
#: Groups of so many values are listed once where no more than MAX_LISTED values differ.
LISTED, MAX_LISTED = 5, 64
#: Bits of the table that decides whether two groups are left.
TABLE_BITS = 1 << 24


class OutOfSteps(Exception):
    pass


class Search:
    """Disjoint groups that sum to zero, in a multiset without opposite values that sums to zero itself.

    What no group takes joins the last one, so all values are used and g groups of n values have n - 3g members beyond three each. Values
    are chosen depth first, on an explicit stack: the value that only large groups can hold is placed first, then the one in fewest groups of three; the
    smallest groups are tried first, and what failed is remembered as a multiset. Two tables over sums cut branches: sets of the sums that k values can have tell the least size
    of a group with each value, and if these sizes are s, no more than the sum of 1/s groups fit; and where two groups are left,
    a table of all subset sums decides."""

    def __init__(self, values: Counter, steps: int):
        self.values = sorted(v for v, n in values.items() if n)
        self.counts = [values[v] for v in self.values]
        self.at = {v: k for k, v in enumerate(self.values)}
        self.widest = max(map(abs, self.values), default=0)
        self.steps, self.failed, self.lists = steps, set(), {}
        self.field = max(self.counts, default=0).bit_length() + 1  # bits of a count in a packed multiset, the highest one free
        self.guard = self.pack([1 << (self.field - 1)] * len(self.values))

    def pack(self, counts: list[int]) -> int:
        return sum(n << (self.field * k) for k, n in enumerate(counts) if n)

    def spend(self, cost: int = 1) -> None:
        self.steps -= cost
        if self.steps < 0:
            raise OutOfSteps

    def least_sizes(self, left: list[int]) -> tuple[list[int], list[int]]:
        """For each value at hand a size that no group with it can be below, and how many groups of three it can be in, counted in both orders.
        Above three a value may count more often than it is there, which only lowers the size."""
        live = [k for k, n in enumerate(left) if n]
        size, threes = [0] * len(left), [0] * len(left)
        if self.widest > WIDEST:
            self.spend(1 + len(live) ** 2 // 100)
            own = {self.values[k] for k in live}
            for k in live:
                threes[k] = sum(-self.values[k] - v in own for v in own)
                size[k] = 3 if threes[k] else 4
            return size, threes
        self.spend(1 + len(live) // 20)
        sums, mirror, middle = 0, 0, self.widest
        for k in live:
            sums |= 1 << (middle + self.values[k])
            mirror |= 1 << (middle - self.values[k])
        open_ = 0
        for k in live:
            v = self.values[k]
            n = (sums & (mirror >> v if v > 0 else mirror << -v)).bit_count()
            if left[k] == 1 and (j := self.at.get(-2 * v)) is not None and left[j]:  # with itself twice
                n -= 2
            if v % 2 == 0 and (j := self.at.get(-v // 2)) is not None and left[j] == 1:  # with another twice
                n -= 1
            threes[k] = n
            if n:
                size[k] = 3
            else:
                open_ += 1
        for depth in range(3, DEEPEST):
            if not open_:
                break
            wider = 0
            for k in live:
                wider |= sums << (self.values[k] + self.widest)
            sums, middle = wider, middle + self.widest
            for k in live:
                if not size[k] and depth > 3 and sums >> (middle - self.values[k]) & 1:
                    size[k] = depth
                    open_ -= 1
        for k in live:
            size[k] = size[k] or DEEPEST
        return size, threes

    def most(self, left: list[int], size: list[int]) -> int:
        return sum(n * UNITS // s for n, s in zip(left, size, strict=True) if n) // UNITS

    def two_groups(self, left: list[int]) -> bool | None:
        """Whether some but not all values sum to zero; None where the table would be too large."""
        reach = sum(n * abs(v) for n, v in zip(left, self.values, strict=True))
        if reach > TABLE_BITS:
            return None
        apart = next(k for k, n in enumerate(left) if n)  # in one of the two groups, so the other is among the rest
        sums = 0
        for k, n in enumerate(left):
            for _ in range(n - (k == apart)):
                v = self.values[k]
                moved = (sums | 1 << reach) << v if v > 0 else (sums | 1 << reach) >> -v
                sums |= moved
                if sums >> reach & 1:
                    return True
        return False

    def groups(self, left: list[int], first: int, size: int) -> Iterator[tuple[int, ...]]:
        """Places of the values of each group of so many values with the first one in it; all but one are chosen, ascending, the last by its sum."""
        left, values, chosen, total, k = left.copy(), self.values, [], self.values[first], 0
        left[first] -= 1
        while True:
            more = size - 1 - len(chosen)
            if more == 1:
                last = self.at.get(-total, -1)
                if last >= (chosen[-1] if chosen else 0) and left[last]:
                    yield (first, *chosen, last)
                k = len(values)
            while k < len(values) and (not left[k] or total + values[k] + (more - 1) * values[-1] < 0):
                k += 1
            if k < len(values) and total + more * values[k] <= 0:
                self.spend()
                chosen.append(k)
                left[k] -= 1
                total += values[k]
            elif chosen:
                k = chosen.pop()
                left[k] += 1
                total -= values[k]
                k += 1
            else:
                return

    def listed(self, left: list[int], first: int, size: int) -> Iterator[tuple[int, ...]]:
        """The same groups from a list that is made once for the whole multiset, where groups are small and values are few."""
        if size > LISTED or len(self.values) > MAX_LISTED:
            yield from self.groups(left, first, size)
            return
        known = self.lists.get((first, size))
        if known is None:
            known = self.lists[first, size] = [(sum(1 << (self.field * k) for k in g), g) for g in self.groups(self.counts, first, size)]
        rest = self.pack(left) | self.guard
        self.spend(len(known) // 16)
        for packed, group in known:
            if (rest - packed) & self.guard == self.guard:
                yield group

    def branch(self, left: list[int], wanted: int) -> bool | Iterator[tuple[int, ...]]:
        """Whether so many groups are in there, if that is plain; else the groups to try, one of which must be among them."""
        self.spend()
        n = sum(left)
        if wanted <= 1:
            return n > 0
        if 3 * wanted > n:
            return False
        size, threes = self.least_sizes(left)
        if self.most(left, size) < wanted:
            return False
        if wanted == 2 and (found := self.two_groups(left)) is not None:
            return found
        first = max((k for k, m in enumerate(left) if m), key=lambda k: (size[k], -threes[k], abs(self.values[k])))
        return (g for s in range(size[first], n - 3 * (wanted - 1) + 1) for g in self.listed(left.copy(), first, s))

    def possible(self, wanted: int) -> bool:
        left, stack = self.counts.copy(), []
        while True:
            name = (wanted, *left)
            tries = False if name in self.failed else self.branch(left, wanted)
            if tries is True:
                return True
            if tries is False:
                self.failed.add(name)
            else:
                stack.append((name, tries, ()))
            while stack:
                name, tries, taken = stack.pop()
                for k in taken:
                    left[k] += 1
                wanted = name[0]
                group = next(tries, None)
                if group is not None:
                    break
                self.failed.add(name)
            else:
                return False
            stack.append((name, tries, group))
            for k in group:
                left[k] -= 1
            wanted -= 1


def some_groups(values: Counter) -> int:
    """Groups found by taking the smallest at hand, each a group; a lower bound."""
    found = 0
    for size in (3, 4):
        while sum(values.values()) >= size + 3:
            search = Search(values, 2000)
            try:
                group = next((g for k in range(len(search.values) - 1, -1, -1) for g in search.groups(search.counts, k, size)), None)
            except OutOfSteps:
                group = None
            if group is None:
                break
            values, found = values - Counter(search.values[k] for k in group), found + 1
    return found + (sum(values.values()) > 0)


@lru_cache(maxsize=100_000)
def zero_groups(values: tuple[int, ...], steps: int = STEPS) -> tuple[int, int]:
    """Bounds of the largest number of disjoint groups that sum to zero; they are equal if the search came to its end."""
    count = Counter(values)
    pairs = sum(min(n, count[-v]) for v, n in count.items() if v > 0)
    rest = Counter({v: n - count[-v] for v, n in count.items() if n > count[-v]})
    if not rest:
        return pairs, pairs
    least, search = some_groups(rest), Search(rest, steps)
    most = sum(rest.values()) // 3
    try:
        most = max(least, min(most, search.most(search.counts, search.least_sizes(search.counts)[0])))
        while least < most and search.possible(least + 1):
            least += 1
        most = least
    except OutOfSteps:
        pass
    return pairs + least, pairs + most


def breakpoints(u, v) -> tuple[int, ...]:
    u, v = np.asarray(u), np.asarray(v)
    steps = np.diff((v - u)[u != 0], prepend=0, append=0)
    return tuple(sorted(steps[steps != 0].tolist()))


def bounds(u, v, steps: int = STEPS) -> tuple[int, int]:
    """The least and the most that the distance from u to v can be."""
    own = breakpoints(u, v)
    low, high = zero_groups(own, steps)
    return len(own) - high, len(own) - low


def distance(u, v) -> int:
    """From u to v; where the search didn't end, the upper bound (``bounds`` tells)."""
    return bounds(u, v)[1]


def batch_bounds(u: pd.Series, v: pd.Series) -> list[tuple[int, int]]:
    """Bounds of many pairs; equal pairs are looked at once."""
    known: dict[tuple[bytes, bytes], tuple[int, int]] = {}
    out = []
    for a, b in zip(u, v, strict=True):
        name = a.tobytes(), b.tobytes()
        if name not in known:
            known[name] = bounds(a, b)
        out.append(known[name])
    return out


@F.pandas_udf(StructType([StructField("dist", IntegerType()), StructField("exact", BooleanType())]))
def event_distance(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """The distance, and whether it is exact; it is the upper bound where not."""
    return pd.DataFrame([(most, least == most) for least, most in batch_bounds(u, v)], columns=["dist", "exact"]).astype({"dist": "int32", "exact": "bool"})


@F.pandas_udf(StructType([StructField("least", IntegerType()), StructField("most", IntegerType())]))
def event_bounds(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(batch_bounds(u, v), columns=["least", "most"], dtype="int32")


def matrix(profiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, i, j, id_i, id_j, dist, exact) over profiles (run_id, ord, cell_id, genome): computed from the earlier to the later one and
    mirrored, with a zero diagonal. A matrix has a row for each pair by nature, and profiles are a biopsy's; a run's pairs are dealt by pairs
    of blocks of its profiles, so no task has more than ``block`` squared of them at a time."""
    at, of = F.floor(F.col("ord") / block), lambda c: c.cast("long")
    blocks = profiles.groupBy("run_id").agg(of(F.max(at)).alias("last"))
    own = profiles.select("run_id", "ord", "cell_id", "genome", of(at).alias("block")).join(blocks, "run_id")
    left = own.select("run_id", F.col("ord").alias("i"), F.col("cell_id").alias("id_i"), F.col("genome").alias("u"), F.col("block").alias("p"), F.explode(F.sequence("block", "last")).alias("q"))
    right = own.select("run_id", F.col("ord").alias("j"), F.col("cell_id").alias("id_j"), F.col("genome").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("p"), F.col("block").alias("q"))
    upper = left.join(right, ["run_id", "p", "q"]).where("i < j").withColumn("d", event_bounds("u", "v"))
    upper = upper.select("run_id", "i", "j", "id_i", "id_j", F.col("d.most").cast("double").alias("dist"), (F.col("d.least") == F.col("d.most")).alias("exact"))
    lower = upper.select("run_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("id_j").alias("id_i"), F.col("id_i").alias("id_j"), "dist", "exact")
    same = profiles.select("run_id", F.col("ord").alias("i"), F.col("ord").alias("j"), F.col("cell_id").alias("id_i"), F.col("cell_id").alias("id_j"), F.lit(0.0).alias("dist"), F.lit(True).alias("exact"))
    return upper.unionByName(lower).unionByName(same)


def steps_of(genome, kept):
    """The steps of a profile over the kept loci, zero before and after them, as (place, step)."""
    own = F.transform(F.filter(F.arrays_zip(genome.alias("c"), kept.alias("k")), lambda z: z["k"]), lambda z: z["c"])
    before, after = F.concat(F.array(F.lit(0)), own), F.concat(own, F.array(F.lit(0)))
    return F.zip_with(after, before, lambda a, b: a - b)


def near(left: DataFrame, right: DataFrame, radius: float, keep_lost: bool = True) -> DataFrame:
    """(run_id, x, y, dist, exact): pairs of left x and right y of one run whose distance from x to y is within the radius.

    left, right: run_id, key, genome; keys are unique in a run of each. With keep_lost, only pairs in which y lost all loci that x lost
    (others can't descend from it). Pairs of equal keys are pairs like any other.

    The loci that x lost decide which loci count, so a run's left profiles fall into classes by lost loci, and a right profile is
    compared within each class (with keep_lost only classes of loci that it lost too). In a class breakpoints are the places in which the steps of x
    and y differ, at most k = 2 * radius of them. A profile's marks are its steps that aren't the class' commonest at their place. Two profiles
    within k places either share one of the k + 1 rarest marks of each (the first mark that both have, in order of rarity, has at most k
    before it in either), or have no mark in common and at most k each; then all places of both count but the shared ones. So pairs
    come from three equi-joins: on rare marks, on places for two profiles with few marks, and on the number of marks where both numbers together are within k.
    Pairs of the last kind are all within k breakpoints. Candidates are measured once, those within k breakpoints exactly."""
    k = int(2 * radius)
    if radius < 0:
        raise ValueError("a radius is not negative")
    mask = F.transform("genome", lambda c: c != 0)
    left = left.select("run_id", "key", "genome", mask.alias("kept"))
    classes = stage(left.groupBy("run_id", "kept").agg(F.count(F.lit(1)).alias("n")), "classes")
    numbers = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "numbers")
    mine = left.join(numbers.drop("n"), ["run_id", "kept"]).withColumn("side", F.lit(0))
    theirs = right.select("run_id", "key", "genome").join(numbers.drop("n"), "run_id")
    if keep_lost:
        theirs = theirs.where(~F.exists(F.zip_with("kept", "genome", lambda keeps, c: ~keeps & (c > 0)), lambda b: b))
    both = mine.select("cls", "side", "key", "genome", "kept").unionByName(theirs.select("cls", F.lit(1).alias("side"), "key", "genome", "kept"))
    both = stage(both.select("cls", "side", "key", "genome", steps_of(F.col("genome"), F.col("kept")).alias("steps")), "steps")

    places = both.select("cls", "side", "key", F.posexplode("steps").alias("place", "step"))
    common = places.groupBy("cls", "place", "step").agg(F.count(F.lit(1)).alias("n"))
    usual = common.groupBy("cls", "place").agg(F.max_by("step", F.struct("n", "step")).alias("usual"))
    usual = usual.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "usual"))), lambda z: z["usual"]).alias("usual"))  # as long as a profile
    marked = both.join(usual, "cls").withColumn("marks", F.filter(F.transform(F.arrays_zip("steps", "usual"), lambda z, i: F.struct(i.alias("place"), z["steps"].alias("step"), (z["steps"] != z["usual"]).alias("odd"))), lambda z: z["odd"]))
    marked = stage(marked.select("cls", "side", "key", "marks", F.size("marks").alias("m")), "marked")

    one = marked.select("cls", "side", "key", "m", F.explode("marks").alias("z")).select("cls", "side", "key", "m", "z.place", "z.step")
    rare = one.join(common, ["cls", "place", "step"])
    first = Window.partitionBy("cls", "side", "key").orderBy("n", "place")  # as many rows as a profile has marks
    rare = rare.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    tokens = rare.select("cls", "side", "key", "m", F.concat_ws(":", F.lit("s"), "place", "step").alias("token"))
    few = marked.where(F.col("m") <= k)
    by_place = one.where(F.col("m") <= k).select("cls", "side", "key", "m", F.concat_ws(":", F.lit("p"), "place").alias("token"))
    by_number = few.select("cls", "side", "key", "m", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), k - F.col("m"))).otherwise(F.array("m"))).alias("others"))
    tokens = stage(tokens.unionByName(by_place).unionByName(by_number.select("cls", "side", "key", "m", F.concat_ws(":", F.lit("m"), "others").alias("token"))), "tokens")
    a = tokens.where("side = 0").select("cls", "token", F.col("key").alias("x"), "m")
    b = tokens.where("side = 1").select("cls", "token", F.col("key").alias("y"), F.col("m").alias("m2"))
    found = a.join(b, ["cls", "token"]).where(F.abs(F.col("m") - F.col("m2")) <= k).select("cls", "x", "y").distinct()

    u = both.where("side = 0").select("cls", F.col("key").alias("x"), F.col("genome").alias("u"), F.col("steps").alias("s"))
    v = both.where("side = 1").select("cls", F.col("key").alias("y"), F.col("genome").alias("v"), F.col("steps").alias("t"))
    differ = F.size(F.filter(F.zip_with("s", "t", lambda p, q: p != q), lambda d: d))
    pairs = found.join(u, ["cls", "x"]).join(v, ["cls", "y"]).where(differ <= k).withColumn("d", event_distance("u", "v"))
    pairs = pairs.select("cls", "x", "y", F.col("d.dist").cast("double").alias("dist"), F.col("d.exact").alias("exact")).where(F.col("dist") <= radius)
    return pairs.join(numbers.select("cls", "run_id"), "cls").select("run_id", "x", "y", "dist", "exact")


"""SimHash near-duplicates with a Gray-order hierarchical index.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Fingerprints link at few differing bits, and
documents are grouped by the links' components.

Tables: of n + 4 blocks of the 64 bits a link of four differing bits agrees in at least n, so there is a table for each choice of n
blocks, with the bits of its blocks in front, and every distinct fingerprint is in each. n follows the number of fingerprints: 1 (5
tables) for millions of them, 2 (15 tables) for hundreds of millions. Any n gives the same links.

Index: a table is sorted by Gray rank, so that neighbours differ in few bits, and groups of neighbours become leaves of a hierarchy: each
node keeps a mask of the bits that all fingerprints below share, and their values. Pairs of nodes are followed from the top, all pairs of a
level at once. Two nodes are compared by the bits that both share; what differs there differs between all their members, and below a node the
differences only accumulate, so a pair beyond the limit is pruned with all below it, and so is a pair that differs in the table's own
blocks, whose links another table finds. Pairs of nodes whose members are already in one component are left out too: what counts is
which fingerprints hang together, and a search returns a spanning forest (at most one link a fingerprint), not all pairs. Every link comes
from this search; there is no other.

Parts: a table is cut by the first bits of its Gray order into parts of about ``PART`` fingerprints, each an index of its own in
one task. No link is lost, as a table's links agree in these bits. Parts above ``MAX_BUCKET`` (fingerprints that crowd together) are dealt
again to tables of twice as many blocks, which are measured in turn; what is still too large after ``ROUNDS`` is cut by a hash
into pieces of half of ``MAX_BUCKET``, and every pair of pieces is searched by a task. So no task holds more, and nothing is capped or dropped.

Components: the links of all parts are joined by large-star and small-star steps, each written to the shared folder, until
nothing changes. Documents of one text or fingerprint are one node from the start, so copies cost nothing. Joins by fingerprint or root
take keys that hold over a thousandth of all rows (fewer than a thousand such keys can be) from a broadcast, so no task gathers a hot one.

Defined cases: null and empty texts have fingerprint zero, which links like any other; a text of fewer words than a shingle hashes
as one; repeated rows keep a row each; a null key can't be the smallest of its component unless all are null; an empty table gives
an empty result; columns beyond those named are ignored, so their names can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from phylospark.llm._shared import discard, fresh, join_hot, slices, small_batches, stage, without

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Members of a leaf, children of a node, pairs of nodes followed at once.
LEAF, FANOUT, PAIRS = 8, 8, 4096
#: Fingerprints of a part on average and at most, those that agree in a table's blocks on average, and times that large parts are dealt again.
PART, MAX_BUCKET, PER_TABLE, ROUNDS = 8192, 50_000, 256, 2


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit majority of shingle hashes: a bit is 1 if it is set in over half of them."""
    own = text.lower().split()
    if not own:
        return 0
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(own) - shingle + 1)
    last = ends[min(shingle, len(own)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a long text in parts
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist())), np.uint64)  # noqa: B905  (last ends it)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp) of every document; fp is the fingerprint as a signed long."""
    rows = small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))

    def read(batches):
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], ["key", "fp"])

    return rows.mapInArrow(read, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each value in Gray order: bit by bit the parity of all bits from the top."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


@dataclass(frozen=True)
class Table:
    """An order of the bits, from the first on: spans (lowest bit, width) of the fingerprint; the first ``own`` bits are the table's blocks."""

    order: tuple[tuple[int, int], ...]
    own: int

    def moved(self, fps: np.ndarray) -> np.ndarray:
        """The fingerprints with their bits in the table's order."""
        out, left = np.zeros_like(fps), 64
        for low, width in self.order:
            left -= width
            out |= ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(left)
        return out

    def first(self, bits: int) -> int:
        """The mask, in the fingerprint, of the table's first bits."""
        mask = 0
        for low, width in self.order:
            take = min(width, bits)
            mask |= ((1 << take) - 1) << (low + width - take)
            bits -= take
        return mask


def tables(parts: int, agree: int) -> list[Table]:
    """The tables of all choices of blocks in which a link may agree."""
    edges = [64 * i // parts for i in range(parts + 1)]
    blocks = [(a, b - a) for a, b in pairwise(edges)]
    return [Table((*chosen, *(x for x in blocks if x not in chosen)), sum(w for _, w in chosen)) for chosen in combinations(blocks, agree)]


class Forest:
    """Union-find over the members of one bucket; the root is the smallest index."""

    def __init__(self, n: int):
        self.up, self.changed = np.arange(n), False

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return int(i)

    def flatten(self) -> None:
        while self.changed:
            above = self.up[self.up]
            self.changed = bool((above != self.up).any())
            self.up = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of a and b, pair by pair; pairs of the same two components are looked at once."""
        n = len(self.up)
        roots = self.up[a], self.up[b]
        apart = roots[0] != roots[1]
        pairs = np.unique(np.minimum(*roots)[apart] * n + np.maximum(*roots)[apart])
        for i, j in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                self.changed = True


class GrayIndex:
    """The hierarchy over distinct fingerprints: level 0 are the leaves, every level above joins ``FANOUT`` nodes."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first member of each node, shared mask, shared values
        starts = np.arange(0, len(fps), leaf)
        ones, zeros = np.bitwise_and.reduceat(self.fps, starts), np.bitwise_and.reduceat(~self.fps, starts)
        self.levels.append((starts, ones | zeros, ones))
        while len(starts) > fanout:
            group = np.arange(0, len(starts), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, group), np.bitwise_and.reduceat(zeros, group)
            starts = starts[group]
            self.levels.append((starts, ones | zeros, ones))
        self.leaf, self.fanout = leaf, fanout

    def uniform(self, found: Forest) -> list[np.ndarray]:
        """For every node of each level the component that all its members are in, or -1."""
        found.flatten()
        starts = self.levels[0][0]
        low, high = np.minimum.reduceat(found.up, starts), np.maximum.reduceat(found.up, starts)
        out = [np.where(low == high, low, -1)]
        for _ in self.levels[1:]:
            group = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, group), np.maximum.reduceat(high, group)
            out.append(np.where(low == high, low, -1))
        return out

    def children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes one level down, each once."""
        below, kids = len(self.levels[level - 1][0]), np.arange(self.fanout)
        left = np.repeat((a[:, None] * self.fanout + kids), self.fanout, axis=1).ravel()
        right = np.tile(b[:, None] * self.fanout + kids, self.fanout).ravel()
        real = (left <= right) & (right < below)
        return left[real], right[real]

    def members(self, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked members of pairs of leaves."""
        n, own = len(self.fps), np.arange(self.leaf)
        i, j = a[:, None] * self.leaf + own, b[:, None] * self.leaf + own
        x, y = self.fps[np.minimum(i, n - 1)], self.fps[np.minimum(j, n - 1)]
        pair, p, q = np.nonzero(np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= limit)
        i, j = i[pair, p], j[pair, q]
        real = (i < j) & (j < n)
        return i[real], j[real]

    def forest(self, limit: int, own: int = 0) -> Forest:
        """Components of the members under links of at most limit differing bits, but for pairs that differ in the first ``own`` bits."""
        out, n = Forest(len(self.fps)), len(self.fps)
        must = np.uint64(((1 << own) - 1) << (64 - own))
        for shift in (1, 2, 3):  # neighbours in Gray order first: dense groups hang together before pairs of nodes are searched
            near = np.flatnonzero(np.bitwise_count(self.fps[shift:] ^ self.fps[:-shift]) <= limit)
            out.link(near, near + shift)
            out.flatten()
        together, work = self.uniform(out), 0

        def open_pairs(level, a, b):
            _, mask, value = self.levels[level]
            differ = (value[a] ^ value[b]) & mask[a] & mask[b]
            one = together[level]
            return (np.bitwise_count(differ) <= limit) & (differ & must == 0) & ((one[a] < 0) | (one[a] != one[b]))

        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS:
                stack.append((level, a[PAIRS:], b[PAIRS:]))
                a, b = a[:PAIRS], b[:PAIRS]
            if out.changed and work > 4 * n:
                together, work = self.uniform(out), 0
            good = open_pairs(level, a, b)
            a, b = a[good], b[good]
            if level and len(a):
                a, b = self.children(level, a, b)
                good = open_pairs(level - 1, a, b)
                stack.append((level - 1, a[good], b[good]))
            elif len(a):
                out.link(*self.members(a, b, limit))
                work += len(a) * self.leaf**2
        out.flatten()
        return out


def part_links(part: np.ndarray, table: np.ndarray, fps: np.ndarray, limit: int, masks: list[Table]) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, another of its component) of all parts; rows of a part lie together."""
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    left, right = [fps[:0]], [fps[:0]]
    for a, n in zip(edge.tolist(), np.diff(np.append(edge, len(part))).tolist(), strict=True):
        if n > 1:
            own, rows = masks[table[a]], fps[a : a + n]
            index = GrayIndex(own.moved(rows))
            up = index.forest(limit, own.own).up
            moved = np.flatnonzero(up != np.arange(n))
            left.append(rows[index.order[up[moved]]])
            right.append(rows[index.order[moved]])
    return np.concatenate(left), np.concatenate(right)


def dealt(fps: DataFrame, masks: list[Table], bits: int) -> DataFrame:
    """(fp, t, bucket) of every table; the bucket is a hash of the table and the first bits of its order."""
    first = [(m - (1 << 64) if m >> 63 else m) for m in (t.first(min(bits, t.own)) for t in masks)]
    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).alias("bucket")) for i, m in enumerate(first)))
    return fps.select("fp", F.inline(keys))


def links_within(rows: DataFrame, limit: int, masks: list[Table]) -> DataFrame:
    """(a, b) linked fingerprints of rows (bucket, t, fp); a bucket holds few enough to lie in one task's memory."""

    def search(batches):
        held: list[np.ndarray] = []

        def ready(batch):
            """Rows of whole buckets; the last bucket waits for more."""
            rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "t", "fp")])
            last = rows[0, -1]
            if rows[0, 0] == last and held and held[-1][0, -1] == last:
                held.append(rows)
                return None
            other = np.flatnonzero(rows[0] != last)
            cut = int(other[-1]) + 1 if len(other) else 0
            whole = np.concatenate([*held, rows[:, :cut]], axis=1)
            held[:] = [rows[:, cut:]]
            return whole

        def found(whole):
            a, b = part_links(whole[0], whole[1], np.ascontiguousarray(whole[2]).view(np.uint64), limit, masks)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows and (whole := ready(batch)) is not None and whole.shape[1]:
                yield found(whole)
        if held:
            yield found(np.concatenate(held, axis=1))

    own = rows.select("bucket", F.col("t").cast("long").alias("t"), "fp")
    return own.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(search, "a bigint, b bigint")


def pieces(rows: DataFrame, large: DataFrame, max_bucket: int) -> DataFrame:
    """Rows of buckets of any size (large: bucket, n) as buckets of at most about max_bucket rows: one for each pair of pieces of a bucket."""
    large = large.withColumn("k", F.ceil(2 * F.col("n") / max_bucket).cast("int") + 1)
    own = join_hot(rows, large, ["bucket"]).withColumn("p", F.pmod(F.xxhash64(F.lit("piece"), "fp"), F.col("k")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda q: F.struct(F.least(q, F.col("p")).alias("i"), F.greatest(q, F.col("p")).alias("j"))))
    own = own.withColumn("pair", pair).where("k = 1 OR pair.i <> pair.j")  # a piece meets itself in any of its pairs
    return own.select(F.xxhash64("bucket", "pair.i", "pair.j").alias("bucket"), "t", "fp")


def all_links(fps: DataFrame, limit: int = DISTANCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links between distinct fingerprints (fp) that give their components."""
    n, agree = fps.count(), 1
    while n > PER_TABLE * 2 ** (64 * agree / (limit + agree)):
        agree += 1
    bits, out = max(0, math.ceil(math.log2(max(1, n) / PART))), None
    for turn in range(ROUNDS + 1):
        masks = tables(limit + agree, agree)
        rows = dealt(fps, masks, bits)
        large = stage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket), "large")
        some = not large.isEmpty()
        own = links_within(without(rows, large, ["bucket"]) if some else rows, limit, masks)
        out = own if out is None else out.unionByName(own)
        if not some:
            return out
        if turn == ROUNDS:
            return out.unionByName(links_within(pieces(rows, large, max_bucket), limit, masks))
        fps = stage(join_hot(rows, large, ["bucket"]).select("fp").distinct(), "again")
        agree, bits = 2 * agree, 64  # all bits of the tables' blocks


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest signed value of its component. links: (a, b)."""
    edges = stage(links.where("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = stage(join_hot(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: the smaller neighbours and the node itself move to the smallest of them
        down = large.where("b < a")
        low = stage(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = join_hot(down, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        after = stage(small, "links")
        same = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        for used in (edges, least, large, low):
            discard(used)
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fingerprint_of(text, shingle: int = SHINGLE, seed: int = SEED):
    """Column: the fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(bytes(t) if t is not None else b"", shingle, seed) for t in texts], np.uint64).view(np.int64))

    return read(text.cast("binary"))


def near_duplicates(docs: DataFrame, key: str, text: str, limit: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, root, component): root stands for the component, component is the smallest key of all documents that links reach."""
    own = stage(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = stage(own.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows")), "nodes")
    roots = components(all_links(nodes.select("fp"), limit))
    nodes = stage(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stage(nodes.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n")), "least")
    named = stage(join_hot(nodes, least, ["root"]).select("fp", "root", "component", F.col("rows").alias("n")), "components")
    return join_hot(own, named, ["fp"]).select(F.col("key").alias(key), "fp", "root", "component")


def keep_one(docs: DataFrame, key: str, text: str, limit: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The documents with all their columns, one row of each component: one with the smallest key. Keys need not be unique; rows that
    share a key are told apart by fingerprint."""
    found = near_duplicates(docs, key, text, limit, shingle).where(F.col(f"`{key}`").eqNullSafe(F.col("component")))
    chosen = stage(found.groupBy("root").agg(F.min("fp").alias("chosen_fp"), F.first(f"`{key}`").alias("chosen")), "chosen")
    again = stage(docs.groupBy(F.col(f"`{key}`").alias("again")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "again")
    own = docs[f"`{key}`"]
    if again.isEmpty():
        return docs.join(chosen, own.eqNullSafe(chosen["chosen"]), "left_semi")
    single = docs.join(again, own.eqNullSafe(again["again"]), "left_anti").join(chosen, own.eqNullSafe(chosen["chosen"]), "left_semi")
    fp = fresh(docs, "fp")
    several = docs.join(again, own.eqNullSafe(again["again"]), "left_semi").withColumn(fp, fingerprint_of(docs[f"`{text}`"], shingle))
    several = several.join(chosen, several[f"`{key}`"].eqNullSafe(chosen["chosen"]) & (several[fp] == chosen["chosen_fp"]), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = several.groupBy(F.col(f"`{key}`").alias("k"), F.col(f"`{fp}`").alias("f")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return single.unionByName(several)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

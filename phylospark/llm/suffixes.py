"""Suffix-array dedup: bytes covered by a string of 200 bytes that starts anywhere else in the collection.

The order of suffixes is built column by column, as in external multi-document construction: each round puts one more symbol in
front of the current suffix of every string, orders the suffixes by that symbol and their former rank (the symbols read in former
order are that column of the Burrows-Wheeler transform), and updates the common prefixes of neighbours: one more than the least
common prefix between their former places, or none where the symbols differ. Symbols come column after column from a sequential
store, and each round needs only the last one's order and prefixes, so memory is a few arrays of one value a string. A suffix whose
common prefix with a neighbour reaches 200 begins a repeated string.

One such construction over all of a corpus would need a round for each byte of its longest text, one after the other. So the
collection is first cut where equal strings fall together. Every string of 200 bytes has an anchor, its 32-byte piece of least
hash; equal strings have equal anchors at the same offset. A document's strings with one anchor are a stretch around it, a segment
of at most 368 bytes. Anchors that occur once in the corpus are dropped; segments around the others are dealt by the anchor, equal
segments once with a count, and aligned at it. Equal strings then begin in the same column, so comparing suffixes within each
column finds every repeat, in at most 368 rounds however long the texts are. Only one column's order and transform exist at a time: columns are not merged
into one order of the whole collection, as suffixes of different columns are never equal for 200 bytes. No hash decides that two strings are
equal: the bytes do, by their common prefixes. (Equal texts and equal segments are found by 128-bit hashes.)

An anchor with more than ``MAX_GROUP`` different segments is dealt on by halves of its columns: all strings that begin in a range of w
columns hold the 200 - w bytes between its last start and its first end, so segments that differ there have no equal string in the range and
may part. Each half is the same construction over its columns, and what is still too large is halved again, ``HALVINGS`` times; single strings of
groups that no halving parts are counted by their bytes. Every way gives the same answer and nothing is capped.

Copies of a text are one text before it is cut, and joins take what belongs to hot texts, anchors and segments from a broadcast, so
no task gathers their rows.

Defined cases: null and empty texts have 0 bytes; texts under 200 bytes keep all; a text that occurs twice and has 200 bytes or more
goes whole; repeats inside one text count, overlapping or not; a null key is kept; an empty table gives an empty result; columns beyond the
key and the text are ignored, so their names can't clash.
"""

from __future__ import annotations

import gc
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from phylospark.llm._shared import discard, join_hot, slices, small_batches, stage, without

LENGTH, PIECE = 200, 32
#: Strings built together, segments of one anchor that stay together, and bytes of text hashed together.
STRINGS, MAX_GROUP, PART = 20_000, 50_000, 256 << 10
#: Times that the columns of too large groups are halved; runs of one text that a broadcast takes at most.
HALVINGS, MAX_RUNS = 4, 4096
#: A byte that UTF-8 never has; it ends a string and equals nothing.
END = 255

# An odd 64-bit base with its inverse modulo 2**64, and an odd multiplier that mixes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIXER = 0xBF58476D1CE4E5B9

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def piece_hashes(data: np.ndarray, piece: int) -> np.ndarray:
    """A mixed hash of every piece of the bytes."""
    up, down = powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    h = (sums[piece:] - sums[:-piece]) * down[: len(data) - piece + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(MIXER)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values, by running minima from both sides of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, hash of the anchor, its position, first and last start of its strings) of all texts, laid end to end meanwhile."""
    found = []
    for d, t in enumerate(texts):  # a text above a part in pieces that overlap, so that each string lies in one
        for at in range(0, len(t) - length + 1, PART) if len(t) > 2 * PART else (0,) if len(t) >= length else ():
            found.append((d, at, t[at : at + PART + length - 1] if len(t) > 2 * PART else t))
    out, group, size = [], [], 0
    for i, x in enumerate(found):
        group.append(x)
        size += len(x[2])
        if size >= PART or i == len(found) - 1:
            out.append(anchors_of(group, length, piece))
            group, size = [], 0
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))


def anchors_of(parts: list[tuple[int, int, bytes]], length: int, piece: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    ends = np.cumsum(sizes)
    hashes = piece_hashes(data, piece)
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 25) - 1)
    place = (sliding_least((hashes & ~low) | places, length - piece + 1) & low).astype(np.int64)
    start = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
    part = np.repeat(np.arange(len(parts)), sizes - length + 1)
    at = place[start]
    edge = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])))
    last = np.append(edge[1:], len(at)) - 1
    own = part[edge]
    shift = np.array([p[1] for p in parts])[own] - (ends - sizes)[own]
    return np.array([p[0] for p in parts])[own], hashes[at[edge]], at[edge] + shift, start[edge] + shift, start[last] + shift


class Columns:
    """Strings of symbols, aligned at a column, read column by column from the right; packed in sequence when large."""

    def __init__(self, strings: list[bytes], before: list[int], memory: int = 32 << 20):
        """before: symbols of each string ahead of the column of alignment."""
        self.n, lead = len(strings), max(before)
        self.width = lead + max(len(s) - b for s, b in zip(strings, before, strict=True))
        self.first = -lead
        starts = [lead - b for b in before]
        self.wide = max(1, memory // max(1, self.n))  # so many columns are laid out at a time
        self.blocks: list[np.ndarray | bytes] = []
        pack = zstandard.ZstdCompressor(level=1).compress if self.wide < self.width else None
        for c in range(0, self.width, self.wide):
            rows = np.full((self.n, min(self.wide, self.width - c)), END, np.uint8)
            for row, s, a in zip(rows, strings, starts, strict=True):
                own = np.frombuffer(s, np.uint8)[max(0, c - a) : max(0, c + rows.shape[1] - a)]
                row[max(0, a - c) : max(0, a - c) + len(own)] = own
            columns = np.ascontiguousarray(rows.T)
            self.blocks.append(pack(columns) if pack else columns)

    def __iter__(self):
        """(column, symbols), from the last column to the first."""
        for k in range(len(self.blocks) - 1, -1, -1):
            block = self.blocks[k]
            if isinstance(block, bytes):
                block = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(-1, self.n)
            for c in range(len(block) - 1, -1, -1):
                yield self.first + k * self.wide + c, block[c]


def least_between(prefixes: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The least of prefixes[after + 1 .. upto] for every pair, after below upto: minima over powers of two."""
    span = upto - after
    level = np.frexp(span)[1] - 1
    levels = [prefixes]
    for k in range(int(level.max(initial=0))):
        above = levels[-1].copy()
        step = 1 << k
        np.minimum(levels[-1][:-step], levels[-1][step:], out=above[: len(above) - step])
        levels.append(above)
    table = np.concatenate(levels)
    base = level * len(prefixes)
    return np.minimum(table[base + after + 1], table[base + upto - (1 << level) + 1])


def repeated_columns(columns: Columns, length: int = LENGTH) -> list[tuple[int, np.ndarray]]:
    """(column, strings whose suffix from there has its first length symbols in common with another's), column by column."""
    order = np.arange(columns.n)
    prefixes = np.zeros(columns.n, np.uint8)  # common prefix with the one before, at most length
    cap, out = np.uint8(min(length, 255)), []
    for column, symbols in columns:
        transform = symbols[order]
        moved = np.argsort(transform, kind="stable")
        order, sorted_symbols = order[moved], transform[moved]
        fresh = np.zeros(columns.n, np.uint8)
        same = np.flatnonzero((sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] != END)) + 1
        if len(same):
            least = least_between(prefixes, moved[same - 1], moved[same])
            fresh[same] = np.minimum(least, cap - np.uint8(1)) + np.uint8(1)
        prefixes = fresh
        long = prefixes >= cap
        if long.any():
            out.append((column, order[long | np.append(long[1:], False)]))
    return out


def repeats(strings: list[bytes], before: list[int], counts: list[int], length: int = LENGTH) -> list[bytes]:
    """For each different string, which of its starts begin a repeated one, as packed bits; the strings are aligned after ``before``."""
    starts = [max(0, len(s) - length + 1) for s in strings]
    marks = np.zeros((len(strings), max(starts)), np.uint8)
    lead = np.array(before)
    for column, rows in repeated_columns(Columns(strings, before), length):
        marks[rows, column + lead[rows]] = 1
    for i, n in enumerate(starts):
        if counts[i] > 1:
            marks[i, :n] = 1
    return [np.packbits(m[:n]).tobytes() for m, n in zip(marks, starts, strict=True)]


def release(spark) -> None:
    """Let the JVM drop the shuffle files of steps whose results are staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_hash(column):
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit("second"), column, F.octet_length(column)).alias("h2")]


def shared_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(h1, h2, hits): the anchors of each text that occur more than once in the collection."""

    def emit(batches):
        for batch in slices(batches, "text"):
            text, own, *_ = anchors(batch.column("text").to_pylist(), length)
            if len(own):
                by = np.lexsort((own, text))
                text, own = text[by], own[by]
                edge = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (own[1:] != own[:-1])))
                take = pa.array(text[edge])
                n = np.diff(np.append(edge, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(own[edge].view(np.int64)), batch.column("h1").take(take), batch.column("h2").take(take), pa.array(n.astype(np.int32))], ["anchor", "h1", "h2", "n"])

    found = rows.where(F.octet_length("text") >= length).mapInArrow(emit, "anchor bigint, h1 bigint, h2 bigint, n int")
    often = stage(found.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("n")).where("all > 1").drop("all"), "often")
    return join_hot(found.select("anchor", "h1", "h2"), often, ["anchor"]).groupBy("h1", "h2").agg(F.collect_set("anchor").alias("hits"))


def segments(rows: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """(h1, h2, start, s1, s2, anchor, before, segment, n): the stretch of text around every shared anchor, n copies of it; staged."""
    texts = rows.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))  # copies are one before they leave a task
    names = ["h1", "h2", "start", "s1", "s2", "anchor", "before", "segment", "n"]

    def cut(batches):
        for whole in batches:
            for batch in slices(iter([whole]), "text"):
                texts = batch.column("text").to_pylist()
                keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
                copies = batch.column("copies").to_pylist()
                text, own, at, first, last = anchors(texts, length)
                hit = batch.column("hits")
                wanted = np.zeros(len(own), bool)
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                for d in np.unique(text).tolist():
                    a, b = bounds[d : d + 2]
                    wanted[a:b] = np.isin(own[a:b], hit[d].values.to_numpy().view(np.uint64))
                out = []
                for d, h, p, a, b in zip(*(x[wanted].tolist() for x in (text, own.view(np.int64), at, first, last)), strict=True):
                    s = texts[d][a : b + length]
                    digest = xxh3_128_digest(s + (p - a).to_bytes(2, "little"))
                    out.append((*keys[d], a, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), h, p - a, s, copies[d]))
                if out:
                    types = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    wanted = texts.join(hits, ["h1", "h2"]).select("h1", "h2", "text", "hits", "copies")
    return stage(wanted.mapInArrow(cut, "h1 bigint, h2 bigint, start bigint, s1 bigint, s2 bigint, anchor bigint, before int, segment binary, n bigint"), "segments")


GROUPED = "group bigint, s1 bigint, s2 bigint, before int, segment binary, n bigint, rows bigint, low int, high int"


def halves(rows: DataFrame, length: int) -> DataFrame:
    """Rows of groups (columns low to high) in a group for each half of the columns and each content that all its strings hold."""
    kind = [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in GROUPED.split(", ")]

    def part(batches):
        for batch in slices(batches, "segment"):
            out = []
            for group, s1, s2, before, s, n, k, low, high in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(a, -before), min(b, len(s) - length - before)  # columns in which a string of this segment begins
                    if first <= last:
                        content = s[before + b : before + a + length]
                        out.append((xxh3_64_intdigest(content + struct.pack("<qii", group, a, b)) - (1 << 63), s1, s2, before, s, n, k, a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind, strict=True)], names)

    return rows.mapInArrow(part, GROUPED)


def repeated_starts(found: DataFrame, length: int, max_group: int) -> DataFrame:
    """(s1, s2, marks, n) of every different segment in which a repeated string begins; a segment may have several rows, n is how many it stands for."""
    single = found.groupBy("s1", "s2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("anchor").alias("group"), F.first("before").alias("before"), F.first("segment").alias("segment"))
    single = stage(single, "strings")
    release(found.sparkSession)

    def build(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def done(rows):
            pairs = zip(rows.column("s1").to_pylist(), rows.column("s2").to_pylist(), strict=True)
            rows = rows.take(pa.array(list({p: i for i, p in enumerate(pairs)}.values())))  # a segment of several groups is one string here
            marks = repeats(*(rows.column(c).to_pylist() for c in ("segment", "before", "n")), length)
            return pa.RecordBatch.from_arrays([rows.column("s1"), rows.column("s2"), pa.array(marks, pa.binary()), rows.column("rows")], ["s1", "s2", "marks", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < STRINGS:
                continue
            rows = pa.concat_batches(held)
            group = rows.column("group").to_numpy()
            other = np.flatnonzero(group != group[-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            held, size = [rows.slice(whole)], len(group) - whole
            if whole:
                yield done(rows.slice(0, whole))
        if size:
            yield done(pa.concat_batches(held))

    def built(rows):
        dealt = rows.select("group", "s1", "s2", "before", "segment", "n", "rows").repartition("group").sortWithinPartitions("group", "s1", "s2")
        return dealt.mapInArrow(build, "s1 bigint, s2 bigint, marks binary, n bigint")

    reach = length - PIECE
    rest, marks = single.select("group", "s1", "s2", "before", "segment", "n", "rows", F.lit(-reach).alias("low"), F.lit(0).alias("high")), None
    for turn in range(HALVINGS + 1):
        large = stage(rest.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group), "large")
        some = not large.isEmpty()
        own = built(without(rest, large, ["group"]) if some else rest)
        marks = own if marks is None else marks.unionByName(own)
        if not some:
            return marks
        rest = join_hot(rest, large, ["group"])
        if turn < HALVINGS:
            rest = stage(halves(rest, length), "halves")
    return marks.unionByName(by_single_strings(rest, length))


def by_single_strings(rows: DataFrame, length: int) -> DataFrame:
    """The same for groups that are still too large to be kept together: their strings are counted one by one, by their bytes."""
    names = ["string", "s1", "s2", "i", "m", "n", "rows"]

    def strings(batches):
        for batch in slices(batches, "segment", 64 << 10):
            out = []
            for s1, s2, before, s, n, k, low, high in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "before", "segment", "n", "rows", "low", "high")), strict=True):
                for i in range(max(0, before + low), min(len(s) - length, before + high) + 1):
                    out.append((s[i : i + length], s1, s2, i, len(s) - length + 1, n, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names)

    @F.pandas_udf("binary")
    def packed(starts, sizes):
        import pandas as pd

        def bits(own, m):
            row = np.zeros(m, np.uint8)
            row[own] = 1
            return np.packbits(row).tobytes()

        return pd.Series([bits(own, m) for own, m in zip(starts, sizes, strict=True)])

    own = rows.mapInArrow(strings, "string binary, s1 bigint, s2 bigint, i int, m int, n bigint, rows bigint")
    often = stage(own.groupBy("string").agg(F.sum("n").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 1").drop("k"), "often_strings")
    marked = join_hot(own.drop("n"), often, ["string"]).groupBy("s1", "s2", "m").agg(F.collect_set("i").alias("i"), F.first("rows").alias("n"))
    return marked.select("s1", "s2", packed("i", "m").alias("marks"), "n")


def covered(starts: list[int], marks: list[bytes], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes (first, past the last) that repeated strings cover."""
    begins = [a + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8))) for a, m in zip(starts, marks, strict=True)]
    at = np.unique(np.concatenate(begins)) if begins else np.empty(0, np.int64)
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, edge + 1)].tolist(), (at[np.append(edge, len(at) - 1)] + length).tolist(), strict=True))


def repeated_spans(docs: DataFrame, text: str, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """(h1, h2, runs, n) of every different text with repeated strings, staged: the maximal runs of bytes they cover, and the text's copies."""
    if not PIECE < length <= 255:
        raise ValueError(f"length must be above {PIECE} and at most 255")
    content = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = small_batches(docs).select(content.alias("text")).select(*text_hash(F.col("text")), "text")
    hits = stage(shared_anchors(rows, length), "anchors")
    release(docs.sparkSession)
    found = segments(rows, hits, length)
    discard(hits)
    release(docs.sparkSession)
    marks = stage(repeated_starts(found, length, max_group), "marks")
    release(docs.sparkSession)
    places = join_hot(found.select("h1", "h2", "start", "s1", "s2", F.col("n").alias("copies")), marks, ["s1", "s2"])
    places = places.groupBy("h1", "h2").agg(F.collect_list("start").alias("starts"), F.collect_list("marks").alias("marks"), F.first("copies").alias("n"))
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def united(batches):
        for batch in batches:
            runs = [[{"a": a, "b": b} for a, b in covered(s, m, length)] for s, m in zip(batch.column("starts").to_pylist(), batch.column("marks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(runs, pa.list_(span)), batch.column("n")], ["h1", "h2", "runs", "n"])

    spans = stage(places.mapInArrow(united, "h1 bigint, h2 bigint, runs array<struct<a: bigint, b: bigint>>, n bigint"), "spans")
    discard(found)
    discard(marks)
    release(docs.sparkSession)
    return spans


def remove_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """(key, n_bytes, kept, spans): the text without repeated bytes, and the runs removed."""
    spans = repeated_spans(docs, text, length, max_group)
    content = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), content.alias("text")).select("key", *text_hash(F.col("text")), "text")
    joined = join_hot(rows, spans, ["h1", "h2"], "left", F.size("runs") <= MAX_RUNS).select("key", "text", "runs")
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def cut(batches):
        for batch in slices(batches, "text"):
            kept, sizes = [], []
            runs = [r or [] for r in batch.column("runs").to_pylist()]
            for t, own in zip(batch.column("text").to_pylist(), runs, strict=True):
                edges = [0, *(x for s in own for x in (s["a"], s["b"])), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(span))], ["key", "n_bytes", "kept", "spans"])

    kind = rows.schema["key"].dataType.simpleString()
    return joined.mapInArrow(cut, f"key {kind}, n_bytes bigint, kept binary, spans array<struct<a: bigint, b: bigint>>").withColumnRenamed("key", key)


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of repeated 200-byte strings."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training words: documents are dealt into segments of a few MB of text, and a segment
holds its terms, how often each occurs and the positions of every term in order. Splitting the index by documents and not by terms
means that no word, however frequent, gathers in one place, and that building it moves no rows between tasks.

A query window of words is searched in a segment from its rarest term: that term's positions, less its offset in the window, are
the candidates, and they are intersected with the offset-adjusted lists of the other terms, rarest first, until none is left. A
window with a term that the segment lacks costs nothing. ``Segment.phrase`` gives exact phrases (``find_items``), ``Segment.near`` the shortest
stretches that hold all terms within a width (``find_near``).

Benchmark items go to the workers in passes of about ``PASS_BYTES`` of text and ``PASS_WINDOWS`` windows (some 100 bytes each); an item with more
windows is cut into pieces that share all but one word of a window, which leaves its windows as they are. Each pass reads the stored index
once and the hits of all passes are merged by document. Defined cases: null and empty texts have no words and no hits; an item without words has no
window; rows that repeat count each; item_ids that repeat count once, a null one is the text "null"; empty tables give no hits or
no rows; columns beyond those named are ignored, so their names can't clash.
"""

from __future__ import annotations

from functools import cached_property
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import slices, small_batches, stage

WINDOW = 10
PASS_BYTES, PASS_WINDOWS = 16 << 20, 200_000

#: Lower case for A-Z, and a space for every byte that isn't part of a word: those outside 0-9, a-z and bytes from 128.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "segment string, keys array<{key}>, starts binary, terms binary, counts binary, postings binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def packed(values: np.ndarray) -> bytes:
    """32-bit values, byte planes apart so that they compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Segment:
    """The postings of some documents; positions count words over all of them."""

    def __init__(self, starts: np.ndarray, terms: list[bytes], counts: np.ndarray, postings: np.ndarray):
        self.starts, self.terms, self.counts, self.postings = starts, terms, counts, postings
        self.ends = np.cumsum(counts)

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Segment:
        split = [words(t) if t else [] for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(w) for w in split])))
        flat = [w for ws in split for w in ws]
        terms = sorted(set(flat))
        code = dict(zip(terms, range(len(terms)), strict=True))
        codes = np.fromiter(map(code.__getitem__, flat), np.int32, len(flat))
        return cls(starts, terms, np.bincount(codes, minlength=len(terms)), np.argsort(codes, kind="stable"))

    def stored(self) -> tuple[bytes, bytes, bytes, bytes]:
        gaps = np.diff(self.postings.astype(np.int64), prepend=0)
        first = self.ends - self.counts
        gaps[first] = self.postings[first]
        return packed(self.starts), b"\n".join(self.terms), packed(self.counts), packed(gaps)

    @classmethod
    def read(cls, starts: bytes, terms: bytes, counts: bytes, gaps: bytes) -> Segment:
        n, steps = unpacked(counts).astype(np.int64), unpacked(gaps).astype(np.int64)
        first = np.cumsum(n) - n
        total = np.cumsum(steps)
        return cls(unpacked(starts).astype(np.int64), terms.split(b"\n") if terms else [], n, total - np.repeat(total[first] - steps[first], n))

    @cached_property
    def places(self) -> dict[bytes, int]:
        return dict(zip(self.terms, range(len(self.terms)), strict=True))

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.ends[term] - self.counts[term] : self.ends[term]]

    def within(self, at: np.ndarray, length: int) -> np.ndarray:
        """Which stretches stay inside one document."""
        return np.searchsorted(self.starts, at, "right") == np.searchsorted(self.starts, at + length - 1, "right")

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which these terms follow each other within a document."""
        found = None
        for offset in np.argsort(self.counts[terms], kind="stable").tolist():
            here = self.positions(terms[offset])
            if found is None:
                found = here - offset
            else:
                at = np.searchsorted(here, found + offset)
                found = found[here[np.minimum(at, len(here) - 1)] == found + offset]
            if not len(found):
                return found
        return found[(found >= 0) & self.within(np.maximum(found, 0), len(terms))]

    def near(self, terms: list[bytes], width: int) -> list[tuple[int, int]]:
        """The shortest stretches (first, past the last position) of at most width words of a document that hold all terms."""
        lists = [self.positions(self.places[t]) for t in set(terms) if t in self.places]
        if len(lists) < len(set(terms)) or not lists:
            return []
        first = np.unique(np.concatenate(lists))
        last = np.zeros(len(first), np.int64)
        for own in lists:
            at = np.searchsorted(own, first)
            last = np.maximum(last, np.where(at < len(own), own[np.minimum(at, len(own) - 1)], 1 << 40))
        shortest = np.append(last[1:] > last[:-1], True)
        keep = shortest & (last - first < width)
        first, last = first[keep], last[keep]
        keep = np.searchsorted(self.starts, first, "right") == np.searchsorted(self.starts, last, "right")
        return list(zip(first[keep].tolist(), (last[keep] + 1).tolist(), strict=True))


class Windows:
    """The distinct windows of some items: rows of term numbers for each length, and the items that have each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            codes = np.array([self.terms.setdefault(w, len(self.terms)) for w in words(text or b"")], np.int32)
            n = min(window, len(codes))
            if n:
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(codes, n), number[item]))
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows, the first of each one's owners, owners
        for _, own in sorted(found.items()):
            rows, place = np.unique(np.concatenate([r for r, _ in own]), axis=0, return_inverse=True)
            owner = np.repeat([i for _, i in own], [len(r) for r, _ in own]).astype(np.int32)
            self.by_length.append((rows, np.append(0, np.cumsum(np.bincount(place.ravel(), minlength=len(rows)))), owner[np.argsort(place.ravel(), kind="stable")]))

    def search(self, segment: Segment) -> list[tuple[int, int, set[str]]]:
        """(position, length, items) of every window that occurs in the segment."""
        place = np.full(len(self.terms) + 1, -1)
        for at, term in enumerate(segment.terms):
            own = self.terms.get(term)
            if own is not None:
                place[own] = at
        found = []
        for rows, first, owner in self.by_length:
            for at in range(0, len(rows), 1 << 15):
                places = place[rows[at : at + (1 << 15)]]
                for i in np.flatnonzero((places >= 0).all(1)).tolist():
                    here = segment.phrase(places[i]).tolist()
                    if here:
                        items = {self.names[k] for k in owner[first[at + i] : first[at + i + 1]].tolist()}
                        found += [(p, rows.shape[1], items) for p in here]
        return found


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The postings of all documents, staged: a row for each segment."""
    rows = small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def index(batches):
        from pyspark import TaskContext

        n = 0
        for batch in slices(batches, "text"):
            stored = Segment.of(batch.column("text").to_pylist()).stored()
            name, n = f"{TaskContext.get().partitionId()}-{n}", n + 1
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key"))
            yield pa.RecordBatch.from_arrays([pa.array([name]), keys, *(pa.array([x], pa.binary()) for x in stored)], ["segment", "keys", "starts", "terms", "counts", "postings"])

    return stage(rows.mapInArrow(index, INDEX.format(key=kind)), "postings")


def search_pass(index: DataFrame, windows: Windows) -> DataFrame:
    """(segment, place, key, n_words, spans, items) of every document; spans are the hit words as (first, past the last)."""
    shared = index.sparkSession.sparkContext.broadcast(windows)
    key = index.schema["keys"].dataType.elementType.simpleString()
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def search(batches):
        for batch in slices(batches, "postings"):
            for name, keys, *stored in zip(*(batch.column(c) for c in ("segment", "keys", "starts", "terms", "counts", "postings")), strict=True):
                segment = Segment.read(*(x.as_py() for x in stored))
                n = len(segment.starts) - 1
                cover, items = np.zeros(int(segment.starts[-1]) + 1, np.int32), [set() for _ in range(n)]
                for p, length, own in shared.value.search(segment):
                    cover[p] += 1
                    cover[p + length] -= 1
                    items[int(np.searchsorted(segment.starts, p, "right")) - 1] |= own
                spans = [[] for _ in range(n)]
                if cover.any():
                    hit = (np.cumsum(cover) > 0).astype(np.int8)
                    hit[-1] = 0
                    for d in np.flatnonzero([bool(x) for x in items]).tolist():
                        a, b = segment.starts[d : d + 2]
                        edge = np.flatnonzero(np.diff(hit[a:b], prepend=0, append=0))
                        spans[d] = [{"a": x, "b": y} for x, y in edge.reshape(-1, 2).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), keys.values, pa.array(np.diff(segment.starts), pa.int64()), pa.array(spans, pa.list_(span)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["segment", "place", "key", "n_words", "spans", "items"],
                )

    return index.mapInArrow(search, f"segment string, place int, key {key}, n_words bigint, spans array<struct<a: bigint, b: bigint>>, items array<string>")


def merged(passes: list[DataFrame]) -> DataFrame:
    """The hits of several passes by document: spans united, items listed once."""
    if len(passes) == 1:
        return passes[0]
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)

    @F.pandas_udf("array<struct<a: bigint, b: bigint>>")
    def united(lists: pd.Series) -> pd.Series:
        out = []
        for spans in lists:
            done: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if done and a <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], b)
                else:
                    done.append([a, b])
            out.append([{"a": a, "b": b} for a, b in done])
        return pd.Series(out)

    rows = rows.groupBy("segment", "place").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.withColumn("spans", united("spans"))


def pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item, text, windows) of items (item, text): those of more than ``most`` windows in pieces of so many."""

    def cut(batches):
        for batch in slices(batches, "text"):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                for at in range(0, max(1, len(own) - window + 1), most):
                    part = own[at : at + most + window - 1]
                    out.append((item, b" ".join(part), max(1, len(part) - window + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["item", "text", "windows"])

    return items.mapInArrow(cut, "item string, text binary, windows bigint")


def find_items(index: DataFrame, benchmark: DataFrame, item: str, text: str, window: int = WINDOW, pass_bytes: int = PASS_BYTES, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """The documents of an index with their hit words and items; see ``search_pass``."""
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    items = stage(pieces(items, window, pass_windows), "items")
    size, windows = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum("windows"), F.lit(0))).collect()[0]
    n = max(1, -(-size // pass_bytes), -(-windows // pass_windows))
    passes = []
    for i in range(n):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()  # pass_bytes and pass_windows, about
        passes.append(search_pass(index, Windows([(r["item"], bytes(r["text"])) for r in own], window)))
    return merged(passes)


def find_near(index: DataFrame, queries: DataFrame, query: str, terms: str, width: int, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query, segment, place, key, n_near): documents of an index that hold all terms (an array of words) of a query within ``width`` words,
    and how many shortest such stretches. A query without terms finds nothing; queries are searched in passes of about ``pass_bytes``."""
    own = stage(queries.select(F.col(f"`{query}`").cast("string").alias("query"), F.col(f"`{terms}`").alias("terms")), "queries")
    size = own.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "terms"))), F.lit(0))).collect()[0][0]
    n = max(1, -(-size // pass_bytes))
    found = None
    for i in range(n):
        part = own.where(F.pmod(F.xxhash64("query", F.concat_ws(" ", "terms")), F.lit(n)) == i).collect()  # pass_bytes, about
        more = near_pass(index, [(r["query"], sorted({w.encode() for w in r["terms"] or () if w})) for r in part], width)
        found = more if found is None else found.unionByName(more)
    return found


def near_pass(index: DataFrame, queries: list[tuple[str, list[bytes]]], width: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)
    key = index.schema["keys"].dataType.elementType

    def search(batches):
        for batch in slices(batches, "postings"):
            for name, keys, *stored in zip(*(batch.column(c) for c in ("segment", "keys", "starts", "terms", "counts", "postings")), strict=True):
                segment = Segment.read(*(x.as_py() for x in stored))
                out = []
                for label, words in shared.value:
                    found = segment.near(words, width)
                    if found:
                        docs, n = np.unique(np.searchsorted(segment.starts, [a for a, _ in found], "right") - 1, return_counts=True)
                        out += [(label, name.as_py(), d, int(k)) for d, k in zip(docs.tolist(), n.tolist(), strict=True)]
                if out:
                    labels, names, places, n = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(names, pa.string()), pa.array(places, pa.int32()), keys.values.take(pa.array(places)), pa.array(n, pa.int64())], ["query", "segment", "place", "key", "n_near"])

    return index.mapInArrow(search, f"query string, segment string, place int, key {key.simpleString()}, n_near bigint")


def n_hit(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which documents hold windows of which benchmark items."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_items(build_index(docs, "doc_id", "text"), benchmark, "item_id", "text")
    out = found.select(F.col("key").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


NEAR_TERMS, NEAR_WIDTH = 3, 8


def near_terms(spark, sf_dir: str) -> DataFrame:
    """Documents that hold the first three different words of a benchmark item within eight words, and how often."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    own = F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0))
    queries = benchmark.select("item_id", F.slice(own, 1, NEAR_TERMS).alias("terms"))
    found = find_near(build_index(docs, "doc_id", "text"), queries, "item_id", "terms", NEAR_WIDTH)
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "n_near")


#: A stretch from each term's place to the farthest of the terms' next places; it is a shortest one if the next place's ends later.
NEAR_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), t AS (
  SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM (SELECT item_id, word, min(i) AS i FROM (SELECT item_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM b) GROUP BY item_id, word)
), q AS (
  SELECT item_id, word, k, max(k) OVER (PARTITION BY item_id) AS n FROM t WHERE k <= {NEAR_TERMS}
), p AS (
  SELECT r, doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w
), h AS (
  SELECT q.item_id, q.n, p.r, p.doc_id, p.pos, {", ".join(f"min(CASE WHEN q.k = {k} THEN p.pos END) OVER ahead AS p{k}" for k in range(1, NEAR_TERMS + 1))} FROM p JOIN q USING (word)
  WINDOW ahead AS (PARTITION BY q.item_id, p.r ORDER BY p.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), s AS (
  SELECT *, CASE WHEN {" AND ".join(f"(n < {k} OR p{k} IS NOT NULL)" for k in range(1, NEAR_TERMS + 1))} THEN greatest({", ".join(f"coalesce(p{k}, 0)" for k in range(1, NEAR_TERMS + 1))}) END AS last FROM h
), e AS (
  SELECT *, lead(last) OVER (PARTITION BY item_id, r ORDER BY pos) AS next FROM s
)
SELECT item_id::VARCHAR AS item_id, doc_id, count(*) AS n_near FROM e WHERE last - pos < {NEAR_WIDTH} AND (next IS NULL OR next > last) GROUP BY item_id, r, doc_id
"""

OP6_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), v AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), g AS (
  SELECT r, n, i, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM v) WHERE len(words) >= n)
), h AS (
  SELECT r, i, v.n, item FROM g JOIN v ON g.win = v.win AND g.n = v.n
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

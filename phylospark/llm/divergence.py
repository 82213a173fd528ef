"""How sources of one language differ in their words: divergences between sources, and the words in which each stands out.

The first pass takes whole texts in blocks of a few megabytes and gives, for each block and language, how many of its documents hold each
word; summed, these are the exact document frequencies, and words in too few documents go. The second pass reads the texts again,
builds for each block an Aho-Corasick automaton of the kept words that the block holds, each padded with the space on both sides so that only
whole words match, and recounts all occurrences by source. A block lives in one Python worker only: no row holds a block's texts or words, since Spark's reader takes
thousands of rows at once and would hold as many blocks. A block's automaton can't grow beyond the block's own words, so no
vocabulary is sent to every task, however large the corpus' is: what is sent is a table of ``SIEVE`` bits (2 MB), one for each hash of a kept word.
Words that get through it by chance (a twentieth where a million words are kept) are counted too and dropped when the counts are joined to the kept
words, so the result is exact whatever the table lets through.

Counts stay sparse: a posting is a (lang, source, word) with occurrences. Shares are smoothed, p = 1 + floor(scale * (count + 1) / (N + V)), so
words that a source lacks all have one share p0, and the divergence sum f(p, q), f = floor((p - q)^2 / q), over all V words is taken apart into

    V f(p0_g, p0_h) + sum over the words of g (f(p_g, p0_h) - f(p0_g, p0_h)) + the same over the words of h
    + sum over common words (f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h) + f(p0_g, p0_h)).

The sums over one source's words need only how often each share occurs. Of the words in which a source stands out, a task hands on only those
that can be among the first. The last sum takes each word's list of postings; a task adds up its
words' pairs in whole numbers and hands on one row for each pair of sources and some two million terms of the sum. There are as many rows as the result
has pairs at least, which the number of sources in a language bounds; no pair of documents or words is made.

All arithmetic is on whole numbers: sums fit 64 bits because the shares of a source sum to the scale and V at most.

Defined cases: null text, lang and source are empty strings. Texts without words count nowhere, but their group is there. A language without
kept words has value 0 for all pairs and no words. Repeated rows are documents of their own. An empty table gives an empty
result. Columns beyond those named are ignored. A very long text is one block; its words are split a megabyte at a time.
Words of over 1,000 characters are counted in the second pass by comparison, not by the automaton.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.llm._shared import slices, small_batches, stage

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
BLOCK_BYTES, PIECE, TERMS, SIEVE = 12 << 20, 1 << 20, 2_000_000, 1 << 24
#: Words above so many characters are counted by comparing words: the automaton has a node a character and frees them by recursion.
LONGEST = 1_000
#: Letters and all bytes of characters beyond ASCII are kept, A-Z lower-cased; anything else becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SECOND = itemgetter(1)
#: Groups of language and source at most; the result has a row for each pair of them in a language.
MAX_GROUPS = 1_000_000


def pieces(text: bytes) -> Iterator[bytes]:
    """Cut at spaces, about a megabyte each."""
    start = 0
    while start < len(text):
        cut = text.find(b" ", start + PIECE) if len(text) - start > PIECE else -1
        end = len(text) if cut < 0 else cut
        yield text[start:end]
        start = end


def words_of(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of translated texts in order, each with one space behind it (so that the array's bytes are a text again), and how many each text has."""
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    space = data == 32
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    keep = ~space
    keep[ends] = True
    data = data[keep]
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = np.flatnonzero(data == 32) + 1
    size = np.diff(np.searchsorted(ends, np.cumsum([len(x) + 1 for x in parts])), prepend=0)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), size


def megabytes(parts: list[bytes]) -> Iterator[list[bytes]]:
    """The parts in lists of about a megabyte each."""
    start = size = 0
    for i, part in enumerate(parts):
        size += len(part)
        if size >= PIECE:
            yield parts[start : i + 1]
            start, size = i + 1, 0
    if start < len(parts):
        yield parts[start:]


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, docs: how many documents of a block hold each word."""
    found: list[pa.Table] = []
    size = 0
    for batch in slices(batches, "text"):
        langs, texts = batch.column("lang").dictionary_encode(), [text.translate(TABLE) for text in batch.column("text").to_pylist()]
        size += sum(map(len, texts))
        if len(texts) == 1:  # however long: what is held are its different words
            words = pa.chunked_array([words_of([x])[0].unique() for x in pieces(texts[0])], pa.binary()).unique()
            lang, docs = pa.repeat(langs[0].as_py(), len(words)), np.ones(len(words), np.int64)
        else:
            words, n = words_of(texts)
            words = words.dictionary_encode()
            most = max(1, len(words.dictionary))
            held = np.sort(np.repeat(np.arange(len(texts)), n) * most + words.indices.to_numpy())
            held = held[np.append(True, held[1:] != held[:-1])[: len(held)]]  # a word of a document once
            held, docs = np.unique(langs.indices.to_numpy()[held // most].astype(np.int64) * most + held % most, return_counts=True)
            lang, words = langs.dictionary.take(pa.array(held // most)), words.dictionary.take(pa.array(held % most))
        found.append(pa.table({"lang": lang, "term": words, "docs": docs}))
        if size >= BLOCK_BYTES:
            yield from count_rows(found)
            found, size = [], 0
    yield from count_rows(found)


def count_rows(found: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    if found:
        table = pa.concat_tables(found).group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum")])
        for rows in table.to_batches():
            terms = pa.compute.binary_slice(rows.column("term"), 0, -1).cast(pa.string())  # without the space
            yield pa.RecordBatch.from_arrays([rows.column("lang"), terms, rows.column("docs_sum")], names=["lang", "term", "docs"])


def word_hash(lang: Column, term: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\0"), term).cast("binary")) % SIEVE


def sieve_of(kept: DataFrame) -> bytes:
    """SIEVE bits, set where a kept word has its hash; whatever their number, no more than that comes to the driver."""
    rows = kept.select(word_hash(F.col("lang"), F.col("term")).alias("h")).groupBy(F.expr("h div 32").alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 32 as int)))").alias("bits")).toArrow()
    bits = np.zeros(SIEVE // 32, "<u4")
    bits[rows["place"].to_numpy()] = rows["bits"].to_numpy()
    return bits.tobytes()


def recount(batches: Iterator[pa.RecordBatch], sieve: bytes) -> Iterator[pa.RecordBatch]:
    """lang, source, term, count of the words of each block that the sieve lets through."""
    texts: dict[str, dict[str, list[bytes]]] = {}
    size = 0
    for batch in slices(batches, "text"):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            texts.setdefault(lang, {}).setdefault(source, []).extend(pieces(text.translate(TABLE)))
            size += len(text)
        if size >= BLOCK_BYTES:
            yield from block_counts(texts, sieve)
            texts, size = {}, 0
    yield from block_counts(texts, sieve)


def block_counts(texts: dict[str, dict[str, list[bytes]]], sieve: bytes) -> Iterator[pa.RecordBatch]:
    """The counts of one block by an automaton over its texts; very long words by comparison."""
    import ahocorasick

    for lang, by_source in texts.items():
        start = crc32(f"{lang}\0".encode())
        chunks = {source: [words_of(x)[0] for x in megabytes(parts)] for source, parts in by_source.items()}
        words = pa.chunked_array([x for own in chunks.values() for x in own], pa.binary()).unique()
        # In the order of the texts: the automaton's first nodes, which lie side by side in memory, are then those of common words.
        kept = [w.decode() for w in words.buffers()[2].to_pybytes().split() if sieve[(h := crc32(w, start) % SIEVE) >> 3] >> (h & 7) & 1] if len(words) else []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(kept):
            if len(word) <= LONGEST:
                automaton.add_word(f" {word} ", k)
        automaton.make_automaton()
        long = {word: k for k, word in enumerate(kept) if len(word) > LONGEST}
        terms = pa.array(kept, pa.string())
        for source, own in chunks.items():
            n = np.zeros(len(kept), np.int64)
            for chunk in own if kept else ():
                text = str(chunk.buffers()[2], "utf-8")
                found = automaton.iter(f" {text}") if len(automaton) else ()
                n += np.bincount(np.fromiter(map(SECOND, found), np.int64), minlength=len(kept))
                for word in text.split(" ") if long else ():
                    if word in long:
                        n[long[word]] += 1
            at = np.flatnonzero(n)
            columns = [pa.repeat(lang, len(at)), pa.repeat(source, len(at)), terms.take(pa.array(at)), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count"])


def divergence(p, q):
    """floor((p - q)^2 / q) of whole numbers, arrays too."""
    return (p - q) * (p - q) // q


def shares(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / size), by long division with three digits at a time, so that no product passes 64 bits."""
    share, left = np.divmod(count + 1, size)
    for _ in range(3):  # SCALE is 1000 to the third
        more, left = np.divmod(left * 1000, size)
        share = share * 1000 + more
    return 1 + share


def common_sums(batches: Iterator[pa.RecordBatch], sizes: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """Sums over common words by (lang, source, item). A row: lang and the lists sources, counts of one word's postings; sizes: N + V of each
    group."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in dict.fromkeys(langs):
            rows = batch.filter(pa.array(langs == lang))
            coded = rows.column("sources").flatten().dictionary_encode()
            names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            of = np.array([sizes[lang, s] for s in names], np.int64)
            p, p0 = shares(rows.column("counts").flatten().to_numpy(zero_copy_only=False), of[source]), shares(np.zeros(len(of), np.int64), of)[source]
            size = np.diff(rows.column("sources").offsets.to_numpy()).astype(np.int64)
            first, size = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)  # of the list that each posting is in
            ends = np.cumsum(size)
            start = 0
            while start < len(p):
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TERMS, "right")))
                k = size[start:end]
                left = np.repeat(np.arange(start, end), k)
                right = np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[start:end], k)
                left, right = left[other := left != right], right[other]
                start = end
                if not len(left):
                    continue
                value = divergence(p[left], p[right]) - divergence(p[left], p0[right]) - divergence(p0[left], p[right]) + divergence(p0[left], p0[right])
                pair = (source[left] * len(names) + source[right]).astype(np.min_scalar_type(len(names) ** 2))  # short numbers are sorted by digits
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
                at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                pairs, total, label = pair[at].astype(np.int64), np.add.reduceat(value[order], at), coded.dictionary
                columns = [pa.repeat(lang, len(pairs)), *(label.take(pa.array(x)) for x in (pairs // len(names), pairs % len(names))), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def marking_terms(batches: Iterator[pa.RecordBatch], sizes: dict[tuple[str, str], int], wholes: dict[str, int], top: int) -> Iterator[pa.RecordBatch]:
    """lang, source, part, item, value: the words in which each source stands out. Of some two million postings at a time only those come on that can
    be among the first of their group: at least as high as the last of these, so alike ones all do."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("counts").flatten())
        if n >= TERMS:
            yield best(pa.Table.from_batches(held), sizes, wholes, top)
            held, n = [], 0
    if n:
        yield best(pa.Table.from_batches(held), sizes, wholes, top)


def best(rows: pa.Table, sizes: dict[tuple[str, str], int], wholes: dict[str, int], top: int) -> pa.RecordBatch:
    """The words of these rows that can be among the first of a group. sizes, wholes: N + V of each group and language."""
    lang, term, lists, counts = (rows.column(c).combine_chunks() for c in ("lang", "term", "sources", "counts"))
    lang, source, count = lang.dictionary_encode(), lists.flatten().dictionary_encode(), counts.flatten().to_numpy()
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    size = np.diff(lists.offsets.to_numpy())
    word = np.repeat(np.arange(len(size)), size)  # of each posting
    known, group = np.unique(lang.indices.to_numpy().astype(np.int64)[word] * len(sources) + source.indices.to_numpy(), return_inverse=True)
    of = np.array([sizes[langs[g // len(sources)], sources[g % len(sources)]] for g in known.tolist()], np.int64)
    whole = np.array([wholes[x] for x in langs], np.int64)[lang.indices.to_numpy()]
    p, q = shares(count, of[group]), shares(np.add.reduceat(count, np.cumsum(size) - size), whole)[word]
    at = np.flatnonzero(p > q)
    value, group = divergence(p[at], q[at]), group[at]
    order = np.lexsort((-value, group))
    at, value, group = at[order], value[order], group[order]
    first = np.searchsorted(group, group)  # place of the group's highest
    keep = value >= value[np.minimum(first + top, np.searchsorted(group, group, "right")) - 1]
    at, value, group = at[keep], value[keep], known[group[keep]]
    columns = [lang.dictionary.take(pa.array(group // len(sources))), source.dictionary.take(pa.array(group % len(sources))), pa.repeat("term", len(at)), term.take(pa.array(word[at])), pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


def smoothed(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), by long division with three digits at a time, so that no product passes 64 bits."""
    size = F.expr(f"{n} + {v}")
    div = lambda a: F.call_function("div", a, size)
    left = F.expr(f"{count} + 1L")
    share = div(left)
    for _ in range(3):  # SCALE is 1000 to the third
        left = left % size * 1000
        share = share * 1000 + div(left)
    return 1 + share


def f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def postings(docs: DataFrame, text: str, lang: str, source: str, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both passes: the postings of each kept word (lang, term, posts: source and count), how many words of a group have each count (lang, source, count, m), and
    the groups (lang, source, n, v), staged. n: all occurrences of kept words in the group, v: the kept words of the language. A word's postings are as many as
    the sources of its language at most."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"))), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    held = small_batches(rows.select("lang", "text")).mapInArrow(document_counts, "lang string, term string, docs long")
    kept = stage(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs), "kept")
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(kept))
    counts = small_batches(rows).mapInArrow(lambda batches: recount(batches, sieve.value), "lang string, source string, term string, count long")
    # Counts move once, dealt by language and word: the sums by source, the join and the lists all keep to that. Before it, few of a task's counts could be summed.
    counts = counts.repartition("lang", "term")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count")).join(kept.select("lang", "term").hint("shuffle_hash"), ["lang", "term"], "left_semi")
    lists = stage(counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("posts")), "postings")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    seen = stage(lists.select("lang", F.explode("posts").alias("x")).groupBy("lang", "x.source", "x.count").agg(F.count(F.lit(1)).alias("m")), "seen")
    totals = seen.groupBy("lang", "source").agg(F.expr("sum(count * m)").alias("n"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    return lists, seen, stage(groups.na.fill(0, ["n", "v"]), "groups")


def audit(lists: DataFrame, seen: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from the others of its language, and the words in which it stands out."""
    known = groups.limit(MAX_GROUPS + 1).collect()
    if len(known) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    sizes = groups.sparkSession.sparkContext.broadcast({(r["lang"], r["source"]): r["n"] + r["v"] for r in known})
    groups = F.broadcast(groups.withColumn("p0", F.when(F.col("v") > 0, smoothed("0L", "n", "v"))))  # MAX_GROUPS rows at most

    wholes = Counter()  # N + V of each language: v is the same in all its groups
    for r in known:
        wholes[r["lang"]] += r["n"]
    wholes = groups.sparkSession.sparkContext.broadcast({r["lang"]: wholes[r["lang"]] + r["v"] for r in known})
    words = small_batches(lists.select("lang", "term", F.col("posts.source").alias("sources"), F.col("posts.count").alias("counts")))
    terms = words.mapInArrow(lambda batches: marking_terms(batches, sizes.value, wholes.value, top), "lang string, source string, part string, item string, value long")

    pair = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "p0", "v").join(pair, "lang").where("source != item")
    base = pairs.select("lang", "source", "item", F.expr(f"coalesce(v * {f('p0', 'q0')}, 0L)").alias("value"))
    seen = seen.join(groups, ["lang", "source"]).select("lang", "source", "m", smoothed("count", "n", "v").alias("p"), "p0")
    others = pair.join(seen, "lang").where("source != item")
    mine = others.select("lang", "source", "item", F.expr(f"m * ({f('p', 'q0')} - {f('p0', 'q0')})").alias("value"))
    theirs = others.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"m * ({f('q0', 'p')} - {f('q0', 'p0')})").alias("value"))
    common = small_batches(words.where("size(sources) > 1").select("lang", "sources", "counts")).mapInArrow(lambda batches: common_sums(batches, sizes.value), "lang string, source string, item string, value long")
    pairs = base.union(mine).union(theirs).union(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(terms).where(F.col("rank") <= top).union(ranked(pairs))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and the words that mark each source."""
    return audit(*postings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), o AS MATERIALIZED (
  SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(words) AS term FROM d) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= 3
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT lang, source, term, sum(n) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense
), t AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM t
), v AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM v
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

import random

import duckdb
import pytest

from phylospark.llm import decontamination as D


def words(text):
    out = [""]
    for c in text or "":
        c = c.lower() if c.isascii() else c
        out = [*out, ""] if c.isascii() and not c.isalnum() else [*out[:-1], out[-1] + c]
    return [w for w in out if w]


def plain(docs, items, window=10):
    """(n_words, n_hit, items) of each text, window by window."""
    out = []
    for t in docs:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(window, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(own) - n + 1) if grams else ():
                if tuple(own[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((len(own), len(hit), sorted(found)))
    return out


def case(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["the", "of", "Éa", "x1", "the", "a-b", "and", "rare" + str(r.randint(0, 30))]) for _ in range(n))
    items = [(str(i), text(r.randint(1, 40))) for i in range(12)] + [("90", None), ("91", "!!"), ("7", "repeated id of two words"), ("92", "the the")]
    docs = [text(r.randint(0, 60)) for _ in range(40)] + [None, "", "the the the the"]
    for _ in range(25):
        w = (r.choice(items)[1] or "").split()
        a = r.randint(0, 20)
        docs.append(text(r.randint(0, 20)) + " , " + "  ".join(w[a : a + r.randint(5, 25)]).upper() + "! " + text(5))
    return docs, items


@pytest.mark.parametrize("pass_bytes", [D.PASS_BYTES, 300])
def test_equals_a_plain_search(spark, pass_bytes):
    docs, items = case(1)
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(docs)], "doc_id long, text string, segment string").repartition(4)
    benchmark = spark.createDataFrame([*items, (None, "only in the null item of this test")], "item_id string, text string")
    items = [*items, ("null", "only in the null item of this test")]
    found = D.find_items(D.build_index(table, "doc_id", "text"), benchmark, "item_id", "text", pass_bytes=pass_bytes)
    got = {r["key"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in found.collect()}
    assert [got[i] for i in range(len(docs))] == plain(docs, items)


def test_query_equals_sql(spark, tmp_path):
    docs, items = case(2)
    con = duckdb.connect()
    for name, rows, kind in (("documents", [*enumerate(docs), (3, docs[3])], "doc_id long, text string"), ("benchmark", [(int(i), t) for i, t in items], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = D.op6_decontamination(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(got.columns)} FROM ({D.OP6_SQL})").fetchall()))


@pytest.mark.parametrize("most", [1, 3, 50])
def test_items_in_pieces(spark, most):
    """Bounds of windows below those of an item change nothing."""
    docs, items = case(3)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    found = D.find_items(D.build_index(table, "doc_id", "text"), spark.createDataFrame(items, "item_id string, text string").repartition(2), "item_id", "text", pass_windows=most * 40)
    cut = D.pieces(spark.createDataFrame([(i, bytearray((t or "").encode())) for i, t in items], "item string, text binary"), 10, most).collect()
    assert max(r["windows"] for r in cut) <= most
    both = [sorted({tuple(w[i : i + 10]) for t in own for w in [D.words(t)] for i in range(max(1, len(w) - 9))}) for own in ([bytes(r["text"]) for r in cut], [(t or "").encode() for _, t in items])]
    assert both[0] == both[1]
    got = {r["key"]: (r["n_words"], sum(s["b"] - s["a"] for s in r["spans"]), r["items"]) for r in found.collect()}
    assert [got[i] for i in range(len(docs))] == plain(docs, items)


def test_windows_take_little_memory():
    import tracemalloc

    r = random.Random(1)
    items = [(str(i), " ".join(f"w{r.randint(0, 50_000)}" for _ in range(1000)).encode()) for i in range(100)]
    tracemalloc.start()
    D.Windows(items)
    assert tracemalloc.get_traced_memory()[1] < 100_000 * 400
    tracemalloc.stop()


def test_near_equals_sql(spark, tmp_path):
    docs, items = case(5)
    con = duckdb.connect()
    for name, rows, kind in (("documents", [*enumerate(docs), (3, docs[3]), (None, "the of and"), (90, "the of " * 30_000)], "doc_id long, text string"), ("benchmark", [(int(i), t) for i, t in items if i != "7"], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = D.near_terms(spark, str(tmp_path))
    wanted = con.execute(f"SELECT {', '.join(got.columns)} FROM ({D.NEAR_SQL})").fetchall()
    assert len(wanted) > 20 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))


def test_near_queries_in_passes(spark):
    """Queries beyond a pass are searched in several, with the same result."""
    r = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") for _ in range(30))) for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(str(k), r.sample("abcdefghi", 3)) for k in range(40)] + [("none", []), ("null", None)], "q string, terms array<string>")
    index = D.build_index(docs, "doc_id", "text")
    whole, parts = (sorted(map(tuple, D.find_near(index, queries, "q", "terms", 6, n).collect()), key=str) for n in (1 << 20, 50))
    assert whole == parts and len(whole) > 100


def test_very_long_text(spark):
    text = "some word " * 200_000 + "one two three four five six seven eight nine ten eleven"
    index = D.build_index(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    (row,) = D.find_items(index, items, "item_id", "text").collect()
    assert (row["n_words"], [tuple(s) for s in row["spans"]], row["items"]) == (400_011, [(400_000, 400_010)], ["1"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(D.build_index(docs, "doc_id", "text"), items, "item_id", "text").count() == 0
    (row,) = D.find_items(D.build_index(some, "doc_id", "text"), items, "item_id", "text").collect()
    assert (row["n_words"], row["spans"], row["items"]) == (2, [], [])


def test_stored_postings_and_proximity():
    r = random.Random(4)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 40))).encode() for _ in range(8)]
    segment = D.Segment.read(*D.Segment.of(texts).stored())
    flat = [(d, w) for d, t in enumerate(texts) for w in t.split()]
    for terms, width in (([b"a", b"b"], 3), ([b"a", b"c", b"e"], 5), ([b"d"], 1), ([b"a", b"zz"], 9)):
        holds = lambda a, b: len({d for d, _ in flat[a:b]}) == 1 and set(terms) <= {w for _, w in flat[a:b]}  # noqa: E731, B023
        wanted = [(a, b) for a in range(len(flat)) for b in range(a + 1, min(len(flat), a + width) + 1) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
        assert segment.near(terms, width) == wanted

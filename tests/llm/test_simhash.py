import random

import numpy as np
import pytest
import xxhash

from phylospark.llm import simhash as S


def plain_components(fps: list[int], limit: int = S.DISTANCE) -> list[int]:
    """The smallest index reachable, by comparing all pairs."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


def plain_fingerprint(text: str) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def mutated(seeds: int, copies: int, flips: int, seed: int = 5) -> list[int]:
    r = random.Random(seed)
    out = set()
    for _ in range(seeds):
        x = r.getrandbits(64)
        for _ in range(copies):
            y = x
            for b in r.sample(range(64), r.randint(0, flips)):
                y ^= 1 << b
            out.add(y)
    return sorted(out)


def test_fingerprints():
    for text in ("", " \n\t", "One", "a b c", "A b\nc d é É E", "x\xa0y z w q " * 50, "the the the the the"):
        assert S.fingerprint(text.encode()) == plain_fingerprint(text), text


@pytest.mark.parametrize("case", [(1, 300, 4), (40, 12, 5), (300, 2, 7), (2, 400, 9)])
def test_gray_index_gives_the_components(case):
    fps = mutated(*case)
    index = S.GrayIndex(np.array(fps, np.uint64), leaf=8, fanout=3)
    own = plain_components([int(x) for x in index.fps])
    assert index.forest(S.DISTANCE).up.tolist() == own


@pytest.mark.parametrize("max_bucket", [S.MAX_BUCKET, 6])
def test_components_of_all(spark, max_bucket):
    fps = mutated(30, 30, 5)
    rows = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in S.components(S.all_links(rows, max_bucket=max_bucket)).collect()}
    groups = lambda of: sorted(sorted(x for x in fps if of(x) == g) for g in {of(x) for x in fps})
    own = dict(zip(fps, plain_components(fps), strict=True))
    assert groups(lambda x: roots.get(x, x)) == groups(own.__getitem__)


def test_documents(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, None), (8, ""), (8, ""), (7, "quite another text of its own"), (None, "a b c d e f g")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component"]) for r in S.near_duplicates(docs, "doc_id", "text").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (7, 7), (None, 3)], key=str)
    assert S.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("own", [13, 26])
def test_links_that_agree_in_a_tables_bits_are_found(own):
    agree = own // 13
    fps = np.array(mutated(60, 12, 5, seed=own), np.uint64)
    found = set()
    for table in S.tables(4 + agree, agree):
        index = S.GrayIndex(table.moved(fps), leaf=4, fanout=3)
        up = index.forest(4, table.own).up
        found |= {(int(fps[index.order[i]]), int(fps[index.order[up[i]]])) for i in range(len(fps)) if up[i] != i}
    places = {int(x): i for i, x in enumerate(fps)}
    links = S.Forest(len(fps))
    links.link(*(np.array([places[p[k]] for p in found]) for k in (0, 1)))
    links.flatten()
    assert links.up.tolist() == plain_components(fps.tolist())


def test_tables_move_every_bit():
    fps = np.array([1 << i for i in range(64)], np.uint64)
    for table in S.tables(6, 2):
        assert sorted(table.moved(fps).tolist()) == fps.tolist()
        first = [x for x in fps.tolist() if table.first(table.own) & x]
        assert len(first) == table.own and all(int(table.moved(np.array([x], np.uint64))[0]) >> (64 - table.own) for x in first)


def test_large_parts_dealt_again_and_in_pieces(spark, monkeypatch):
    """Far more fingerprints that crowd together than a part may hold, at every step of the way."""
    fps = sorted({x ^ (i % 7) for i, x in enumerate(mutated(3, 250, 9))})
    rows = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").cache()
    own = plain_components(fps)
    for rounds, limit in ((0, 40), (1, 40), (2, 200)):
        monkeypatch.setattr(S, "ROUNDS", rounds)
        links = S.Forest(len(fps))
        at = {x: i for i, x in enumerate(fps)}
        pairs = [(at[r["a"] % 2**64], at[r["b"] % 2**64]) for r in S.all_links(rows, max_bucket=limit).collect()]
        links.link(*(np.array(x, int) for x in zip(*pairs, strict=True)))
        links.flatten()
        assert links.up.tolist() == own


def test_hot_component_and_hot_fingerprint(spark):
    texts = ["same text of many copies here"] * 300 + [f"text number {i} of the others alone here" for i in range(40)] + [None] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in S.near_duplicates(docs, "doc_id", "text").collect()}
    root = plain_components([plain_fingerprint(t or "") for t in texts])
    assert got == dict(enumerate(root))


def test_very_long_text():
    text = "word " * 400_000 + "end"
    assert S.fingerprint(text.encode()) == plain_fingerprint("word " * 5000)


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "delta", "Ä", "x"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts = base + [t + " end" for t in base[:25]] + base[:5] + [None, "", " \n"]
    spark.createDataFrame([(500 - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    prints = [plain_fingerprint(t or "") for t in reversed(texts)]  # by rising doc_id
    root = plain_components(prints)
    first = 501 - len(texts)
    wanted = sorted((first + i, f"{p:016x}", first + root[i]) for i, p in enumerate(prints))
    assert sorted(map(tuple, S.op9_simhash(spark, str(tmp_path)).collect())) == wanted

import random

import numpy as np
import pytest

from phylospark.llm import suffixes as S


def plain_spans(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The runs covered by strings that start at two places or more, by a table of all strings."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = 1
        edge = np.flatnonzero(np.diff(cover, prepend=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def corpus(seed: int, n: int = 60) -> list[str]:
    r = random.Random(seed)
    words = ["the", "of", "é", "ander", "x", "tion", "zz", "\n", "a b"]
    text = lambda k: " ".join(r.choice(words) + str(r.randint(0, 99) if r.random() < 0.5 else "") for _ in range(k))
    passages = [text(60) for _ in range(4)]
    out = []
    for _ in range(n):
        t = text(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 200)
            t += p[a : a + r.randint(150, 330)] + text(r.randint(0, 40))
        out.append(t)
    return out + [out[0], out[0], "a" * 1500, "ab" * 400, "", "short", text(300), "é" * 99 + "x", "z" * 199, "q" * 200, "q" * 200]


def test_powers_wrap():
    up, down = S.powers(1000)
    assert (up * down == 1).all()


def test_anchors_follow_the_content():
    t = corpus(1)[3].encode() * 3
    u = b"something before " + t + b" and after"
    shift = len(b"something before ")
    of = lambda x: {p: h for _, h, at, a, b in zip(*(c.tolist() for c in S.anchors([x])), strict=True) for p in [at]}
    own, other = of(t), of(u)
    assert all(other.get(p + shift) == h for p, h in own.items())


@pytest.mark.parametrize("memory", [32 << 20, 500])
def test_columns_find_what_a_table_finds(memory, monkeypatch):
    r = random.Random(3)
    strings = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(5, 30))) for _ in range(300)})
    before = [r.randint(0, 4) for _ in strings]
    length = 5
    count: dict[tuple[int, bytes], int] = {}
    at = lambda s, b: [(i - b, s[i : i + length]) for i in range(len(s) - length + 1)]
    for s, b in zip(strings, before, strict=True):
        for w in at(s, b):
            count[w] = count.get(w, 0) + 1
    found = {(c, i) for c, rows in S.repeated_columns(S.Columns(strings, before, memory), length) for i in rows.tolist()}
    assert found == {(c, i) for i, (s, b) in enumerate(zip(strings, before, strict=True)) for c, w in at(s, b) if count[c, w] > 1}


@pytest.mark.parametrize(("seed", "max_group"), [(1, S.MAX_GROUP), (2, S.MAX_GROUP), (3, 1)])
def test_documents_equal_brute_force(spark, seed, max_group, monkeypatch):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y")], "doc_id long, text string, spans string").repartition(5)
    got = {r["doc_id"]: ([(s["a"], s["b"]) for s in r["spans"]], bytes(r["kept"])) for r in S.remove_repeats(docs, "doc_id", "text", max_group=max_group).collect()}
    own = [t.encode() for t in texts]
    assert got.pop(None) == ([], b"")
    for i, spans in enumerate(plain_spans(own, S.LENGTH)):
        assert got[i][0] == spans, i
        edges = [0, *(x for s in spans for x in s), len(own[i])]
        assert got[i][1] == b"".join(own[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_long_text_in_parts(monkeypatch):
    text = b"".join(x.encode() for x in corpus(5))
    whole = S.anchors([text])
    monkeypatch.setattr(S, "PART", 1000)
    parts = S.anchors([text])
    cover = lambda x: sorted((p, h, at) for h, at, a, b in zip(*(c.tolist() for c in x[1:]), strict=True) for p in range(a, b + 1))
    assert cover(whole) == cover(parts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs, "doc_id", "text").count() == 0


@pytest.mark.parametrize(("halvings", "max_group"), [(0, 1), (1, 3), (3, 5), (8, 2)])
def test_large_groups_on_both_sides_of_every_limit(spark, halvings, max_group, monkeypatch):
    """One passage inside many different texts: halved, halved again, or counted by its strings, the answer is the same."""
    monkeypatch.setattr(S, "HALVINGS", halvings)
    r = random.Random(halvings)
    noise = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage = noise(260)
    texts = [noise(r.randint(0, 250)) + passage[r.randint(0, 40) : 260 - r.randint(0, 40)] + noise(r.randint(0, 250)) for _ in range(25)] + corpus(9, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: [(s["a"], s["b"]) for s in x["spans"]] for x in S.remove_repeats(docs, "doc_id", "text", max_group=max_group).collect()}
    assert [got[i] for i in range(len(texts))] == plain_spans([t.encode() for t in texts], S.LENGTH)


def test_hot_text_and_long_text(spark, monkeypatch):
    """A text with most of the rows, and one with more runs than a broadcast takes."""
    monkeypatch.setattr(S, "MAX_RUNS", 2)
    r = random.Random(6)
    parts = ["".join(r.choice("abcdefghij ") for _ in range(230)) for _ in range(8)]
    long = "".join(p + "".join(r.choice("xyz") for _ in range(90)) for p in parts)
    texts = [long] * 30 + [parts[0] + "end"] * 20 + parts + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: [(s["a"], s["b"]) for s in x["spans"]] for x in S.remove_repeats(docs, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == plain_spans([(t or "").encode() for t in texts], S.LENGTH)


def test_query_equals_brute_force(spark, tmp_path):
    from hashlib import sha256

    texts = corpus(7, 20) + [None]
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").write.parquet(str(tmp_path / "documents.parquet"))
    own = [(t or "").encode() for t in texts]
    for r, spans in zip(sorted(S.op10_suffixes(spark, str(tmp_path)).collect()), plain_spans(own, S.LENGTH), strict=True):
        t = own[r["doc_id"]]
        edges = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        assert tuple(r) == (r["doc_id"], len(t), len(t) - len(kept), len(spans), sha256(kept).hexdigest())

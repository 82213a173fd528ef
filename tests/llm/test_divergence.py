import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phylospark.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string, term string, p int, rank string"


def write(spark, tmp_path, docs):
    spark.createDataFrame([(i, *d, "clash", 1, "clash") for i, d in enumerate(docs)], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def brute(docs, top=200):
    """From the definition, every group with every kept word."""
    out = []
    rows = [(t or "", lang or "", s or "") for t, lang, s in docs]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    for lang in {r[1] for r in rows}:
        own = [(s, w) for (_, x, s), w in zip(rows, terms, strict=True) if x == lang]
        holds = Counter(w for _, ws in own for w in set(ws))
        kept = sorted(w for w, n in holds.items() if n >= 3)
        counts, whole = defaultdict(Counter), Counter()
        for s, ws in own:
            counts[s].update(w for w in ws if w in set(kept))
            whole.update(w for w in ws if w in set(kept))
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept} for s, c in counts.items()}
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [("pair", o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            words = [("term", w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for found, most in ((pairs, len(pairs)), (words, top)):
                for rank, (part, item, value) in enumerate(sorted(found, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def odd_rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "ÉCLAIR", "éclair", "naïve", "中文", "x", "a", "ab", "abc", "b", "\U0001f600", "don't", "e-mail", "C3PO", "\u00a0", "K", "ſ"]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s1", "É", None, "hot", "hot"])) for _ in range(150)]
    docs += [(None, "en", "silent"), ("", "xx", "s0"), ("1 2 3", "xx", "s1"), ("alone words here", "yy", "s0"), ("a\x00b\tb\nB_b", "en", "s0")] + [("same text again", "zz", "s0")] * 5 + [("same TEXT", "zz", "s1")]
    return docs + [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(260)), "many", s) for s in ("s0", "s0", "s1", "s2")] + [("taa " * 50, "many", "s2")]


def test_equals_brute_force_and_sql(spark, tmp_path):
    docs = odd_rows()
    path = write(spark, tmp_path, docs)
    out = D.op13_divergence(spark, path)
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(D.OP13_SQL).fetchall()) == got and out.columns == [c[0] for c in con.description]


@pytest.mark.parametrize("docs", [[], [(None, None, None)], [("a", "en", "x"), ("a", "en", "y")]])
def test_empty_and_without_kept_words(spark, tmp_path, docs):
    assert sorted(tuple(r) for r in D.op13_divergence(spark, write(spark, tmp_path, docs)).collect()) == brute(docs)


def test_a_very_long_text(spark, tmp_path):
    """Cut at a space every megabyte; a word longer than that stays whole."""
    long = "one two " * 300_000 + "w" * 2_500_000 + " two one"
    docs = [(long, "en", "s0"), (long, "en", "s1"), ("one " + "w" * 2_500_000, "en", "s1"), ("two one", "en", "s2")]
    assert sorted(tuple(r) for r in D.op13_divergence(spark, write(spark, tmp_path, docs)).collect()) == brute(docs)


def test_common_sums_in_pieces(monkeypatch):
    """Sums of pairs don't depend on where the lists are cut."""
    rng = np.random.default_rng(1)
    sizes = {("en", f"s{x}"): int(rng.integers(10**3, 10**11)) for x in range(12)}
    lists = [[(f"s{x}", int(rng.integers(1, 10**12 if x % 3 else 10))) for x in rng.choice(12, size=rng.integers(2, 13), replace=False)] for _ in range(300)]
    sizes = {k: v + sum(n for one in lists for s, n in one if s == k[1]) for k, v in sizes.items()}
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 300), *(pa.array([[x[i] for x in one] for one in lists]) for i in range(2))], names=["lang", "sources", "counts"])
    wanted = Counter()
    f = D.divergence
    share = lambda n, s: 1 + 10**9 * (n + 1) // sizes["en", s]
    for one in lists:
        for g, n in one:
            for h, m in one:
                if g != h:
                    p, q, p0, q0 = share(n, g), share(m, h), share(0, g), share(0, h)
                    wanted[g, h] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    for limit in (1, 100, 10**9):
        monkeypatch.setattr(D, "TERMS", limit)
        got = Counter()
        for out in D.common_sums(iter([batch]), sizes):
            for r in out.to_pylist():
                got[r["source"], r["item"]] += r["value"]
        assert got == wanted


def test_no_staged_row_holds_a_block(spark, tmp_path, monkeypatch):
    """Spark reads thousands of rows at once, so rows with the texts or words of a block would fill an executor's memory."""
    docs = [(f"common words and w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 200, "en", f"s{i % 2}") for i in range(300)]
    longest = {}

    def staged(df, name):
        out = stage(df, name)
        longest[name] = out.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0]
        return out

    stage = D.stage
    monkeypatch.setattr(D, "stage", staged)
    assert sorted(tuple(r) for r in D.op13_divergence(spark, write(spark, tmp_path, docs)).collect()) == brute(docs)
    assert longest and max(longest.values()) < 1000, longest


def test_counts_move_once(spark, tmp_path, monkeypatch):
    """Counts are dealt by language and word once; sums by source, the join with the kept words and the lists need no second shuffle."""
    plans = {}

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    stage = D.stage
    monkeypatch.setattr(D, "stage", staged)
    docs = odd_rows()
    assert sorted(tuple(r) for r in D.op13_divergence(spark, write(spark, tmp_path, docs)).collect()) == brute(docs)
    assert len(re.findall(r"Exchange hashpartitioning", plans["postings"])) == 2, plans["postings"]  # the counts' and the kept words'


def test_postings_are_not_all_ranked(spark, tmp_path, monkeypatch):
    """Only words that can be among the first 200 of a group reach the window that ranks them."""
    docs = [(" ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)) + f" all{c}" * i, "en", f"s{c}") for c in "ab" for i in range(4)]
    seen = []
    best = D.best
    monkeypatch.setattr(D, "best", lambda *a: seen.append(best(*a)) or seen[-1])
    lists = [{"lang": "en", "term": w, "sources": ["sa"], "counts": [n]} for w, n in [(f"t{i:03}", 2 + i % 300) for i in range(1200)]]
    sizes, total = {("en", "sa"): 10**6, ("en", "sb"): 10**6}, 2 * 10**6
    batches = [pa.RecordBatch.from_pylist(lists[i : i + 300]) for i in range(0, 1200, 300)]
    found = [r for b in D.marking_terms(iter(batches), sizes, {"en": total}, 200) for r in b.to_pylist()]
    share = lambda n, s: 1 + 10**9 * (n + 1) // s
    value = {x["term"]: D.divergence(share(x["counts"][0], 10**6), share(x["counts"][0], total)) for x in lists}
    first = sorted(value, key=lambda w: (-value[w], w))[:200]
    assert {r["item"] for r in found} >= set(first) and len(found) < 300 and all(r["value"] == value[r["item"]] for r in found)
    monkeypatch.setattr(D, "TERMS", 1)  # a batch at a time
    assert {r["item"] for b in D.marking_terms(iter(batches), sizes, {"en": total}, 200) for r in b.to_pylist()} >= set(first)
    assert len(seen) == 5
    assert sorted(tuple(r) for r in D.op13_divergence(spark, write(spark, tmp_path, docs)).collect()) == brute(docs)


def test_documents_of_each_word(monkeypatch):
    """Counts by Arrow equal those by sets, wherever blocks, slices and pieces end."""
    rng = random.Random(5)
    text = lambda k: "".join(rng.choices(["a", "B", "é", "中", " ", "  ", "\n", "7", "the ", "\x00"], k=k))
    rows = [{"lang": rng.choice(["en", "", "é"]), "text": text(rng.choice([0, 1, 3, 40, 400])).encode()} for _ in range(300)] + [{"lang": "en", "text": text(5000).encode()}, {"lang": "en", "text": b"   "}]
    wanted = Counter((r["lang"], w.decode()) for r in rows for w in set(r["text"].translate(D.TABLE).split()))
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 50]) for i in range(0, len(rows), 50)]
    limit = D.slices
    for most, block, piece in ((1, 1, 1), (1000, 3000, 7), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(D, "slices", lambda b, c, most=most: limit(b, c, most))
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        monkeypatch.setattr(D, "PIECE", piece)
        got = Counter()
        for out in D.document_counts(iter(batches)):
            for r in out.to_pylist():
                got[r["lang"], r["term"]] += r["docs"]
        assert got == wanted
    words, size = D.words_of([b" a  b", b"", b"  ", b"c "])
    assert words.to_pylist() == [b"a ", b"b ", b"c "] and size.tolist() == [2, 0, 0, 1]

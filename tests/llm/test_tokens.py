import base64
import os
import random

import numpy as np
import pytest

from phylospark.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="the vocabulary file is elsewhere")


def blocks(spark, files, size):
    rows = [(f, b, bytearray(np.array(own[a : a + size], "<u2").tobytes()), None) for f, own in enumerate(files) for b, a in enumerate(range(0, len(own), size))]
    return spark.createDataFrame(rows, "file int, block long, payload binary, keys array<long>").repartition(5)


@pytest.mark.parametrize(("size", "wide"), [(1, 4), (3, 1), (7, 2), (1000, 4096)])
def test_scan_equals_a_plain_loop(spark, monkeypatch, size, wide):
    monkeypatch.setattr(K, "RANGE", wide)
    r = random.Random(size)
    files = [[r.choice([0, 0, 1, 2, 3]) for _ in range(n)] for n in (0, 1, 50, 333)] + [[0, 0, 0], [1] * 40, [1, 1, 0, 2]]
    wanted, tails = {}, {}
    for f, own in enumerate(files):
        run, counts = 0, []
        for t in own:
            run += 1
            if t == 0:
                counts.append(run - 1)
                run = 0
        wanted[f] = counts
        if run:
            tails[f] = run
    rows = blocks(spark, files, size)
    got = {f: [] for f in wanted}
    for r in sorted(K.count_tokens(rows, 0).collect(), key=lambda r: (r["file"], r["block"], r["place"])):
        got[r["file"]].append(r["n_tokens"])
    assert got == wanted
    assert {r["file"]: r["n_tokens"] for r in K.open_tail(rows, 0).collect()} == tails


def test_documents_equal_the_tokenizer(spark):
    import tiktoken

    texts = ["", None, "one", "one two three " * 500, "é\n\n ñ 123!", "", "x" * 5000, "<|endoftext|> as text"]
    docs = spark.createDataFrame([(i % 6, t, "k") for i, t in enumerate(texts)] + [(None, "null key", "k")], "doc_id long, text string, keys string").repartition(3)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.VOCABULARY, "rb"))}  # noqa: SIM115
    plain = tiktoken.Encoding("plain", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = sorted((str(i % 6), len(plain.encode_ordinary(t or ""))) for i, t in enumerate(texts)) + [("None", len(plain.encode_ordinary("null key")))]
    for size in (4, 100, K.BLOCK_TOKENS):
        own = K.write_tokens(docs, "doc_id", "text", K.Vocabulary(spark, K.VOCABULARY), block_tokens=size)
        got = [(str(r["key"]), r["n_tokens"]) for r in K.count_tokens(own).collect()]
        assert sorted(got) == sorted(wanted)
    assert K.count_tokens(K.write_tokens(docs.limit(0), "doc_id", "text", K.Vocabulary(spark, K.VOCABULARY))).count() == 0


def test_plain_files(spark, tmp_path):
    for name, own in (("a", [5, 6, 9, 9, 7, 9]), ("b", [1, 2, 3])):
        (tmp_path / name).write_bytes(np.array(own, "<u2").tobytes())
    rows = K.token_files(spark, str(tmp_path), block_tokens=2)
    assert sorted(r["n_tokens"] for r in K.count_tokens(rows, 9).collect()) == [0, 1, 2]
    assert [r["n_tokens"] for r in K.open_tail(rows, 9).collect()] == [3]


def test_plain_files_by_ranges(spark, tmp_path):
    """Ranges of files give what a plain loop over the whole files gives; an odd byte and an empty file add nothing."""
    r = random.Random(4)
    wanted = []
    for name, n, odd in (("a", 5000, b""), ("b c", 1, b"x"), ("d", 777, b"y"), ("e", 0, b"")):
        own = [r.choice([9, 1, 2, 3, 4, 5, 6, 7]) for _ in range(n)] + ([9] if n else [])
        (tmp_path / name).write_bytes(np.array(own, "<u2").tobytes() + odd)
        run = 0
        for t in own:
            wanted, run = (wanted + [run], 0) if t == 9 else (wanted, run + 1)
    for size in (3, 64, 100_000):
        rows = K.token_files(spark, str(tmp_path), block_tokens=size)
        assert max(len(x["payload"]) for x in rows.collect()) <= 2 * size
        assert sorted(x["n_tokens"] for x in K.count_tokens(rows, 9).collect()) == sorted(wanted)


def test_one_file_of_a_million_separators(spark):
    """The rows that are ordered have a fixed width, whatever a block holds."""
    own = np.random.default_rng(3).integers(0, 3, 3_000_000).astype("<u2")
    size = 1 << 14
    rows = blocks(spark, [own], size)
    ends = np.flatnonzero(own == 0)
    assert len(ends) > 900_000
    got = K.count_tokens(rows, 0).agg({"n_tokens": "sum", "*": "count"}).first()
    assert tuple(got) in ((len(ends), int(ends[-1]) + 1 - len(ends)), (int(ends[-1]) + 1 - len(ends), len(ends)))
    assert [f.dataType.simpleString() for f in K.scan(K.search(rows, 0)).schema] == ["int", "bigint", "bigint", "boolean", "bigint", "bigint"]


def test_query_equals_the_tokenizer(spark, tmp_path):
    texts = ["one two", None, "", "long " * 50_000, "é ñ", "one two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    encoding = K.Vocabulary(spark, K.VOCABULARY).encoding()
    got = sorted(map(tuple, K.op1_tokens(spark, str(tmp_path)).collect()))
    assert got == [(i, len(encoding.encode_ordinary(t or ""))) for i, t in enumerate(texts)]

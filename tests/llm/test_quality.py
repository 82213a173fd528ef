import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylospark.llm import quality as Q


def corpus(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "and", "er", "ing", "tion", "re", "st"]) for _ in range(r.randint(1, 3)))
    good = lambda: " ".join(word() for _ in range(r.randint(30, 300))) + "."
    bad = lambda: r.choice([" | ".join(word() for _ in range(80)), " ".join(word().upper() + "!!" for _ in range(80)), (word() + " ") * 200, " ".join(word() + "%%%" for _ in range(90))])
    return [(i, good() if y else bad(), y) for i, y in ((i, int(r.random() < 0.8)) for i in range(n))]


def test_held_out_accuracy_and_no_leak(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(3, None, 0), (None, 1, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.train(docs, flipped) == model  # labels of the held-out fold are not used
    assert Q.train(docs.repartition(5), labels.repartition(3)) == model
    got = docs.select("doc_id", Q.held_out(F.col("doc_id")).alias("out"), Q.scorer(model)(F.col("text")).alias("s")).collect()
    y = {i: v for i, _, v in rows}
    own = [(r["s"] >= Q.THRESHOLD) == y[r["doc_id"]] for r in got if r["out"]]
    assert len(own) > 60 and np.mean(own) > 0.97
    assert all(0 <= r["s"] <= 1 for r in got)


def test_texts_that_say_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "\x00" * 10)], "doc_id long, text string")
    model = Q.fit([b"good text of some length " * 20] * 9, [b"## || ##" * 30] * 9, 0.8)
    got = {r["doc_id"]: r["s"] for r in rows.select("doc_id", Q.scorer(model)(F.col("text")).alias("s")).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert rows.limit(0).select(Q.scorer(model)(F.col("text"))).count() == 0


def test_without_labels(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = Q.train(rows, spark.createDataFrame([], "doc_id long, quality int"))
    assert rows.select(Q.scorer(model)(F.col("text")).alias("s")).first()["s"] == pytest.approx(0.5)


def test_long_texts_and_frequent_keys_leave_the_others(spark):
    rows = corpus(120)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    train = lambda docs, n=64 << 10: Q.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, max_bytes=n)
    inside = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % Q.FOLDS]
    first = min((i for i, _, y in inside if y), key=lambda i: zlib.crc32(f"sample{i}".encode()))
    plain = [(i, t) for i, t, _ in rows]
    without = train([r for r in plain if r[0] != first])
    assert without.curves and train([(i, t if i != first else t * 500) for i, t in plain]) == without  # a text above the bound, first in its class
    assert train(plain + [r for r in plain if r[0] == first] * 300) == train(plain)  # a key with most of all rows
    with pytest.raises(ValueError, match="label 1"):
        train([(i, t * (500 if y else 1)) for i, t, y in rows])


def test_logistic_finds_the_weights():
    r = np.random.default_rng(3)
    x = r.normal(size=(20_000, 2))
    y = (r.random(20_000) < 1 / (1 + np.exp(-(x @ [1.5, -0.5] + 0.3)))).astype(float)
    assert Q.logistic(x, y, np.ones(len(y))) == pytest.approx([1.5, -0.5, 0.3], abs=0.1)


def test_query(spark, tmp_path):
    rows = corpus(300)
    texts = [(i, t, 0) for i, t, _ in rows] + [(900, None, 0), (901, "", 0), (None, "the and", 0), (5, rows[5][1], 0)]
    spark.createDataFrame(texts, "doc_id long, text string, predicted int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    model = Q.train(*(spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels")))
    sizes = Q.Sizes(model.good, model.bad)
    wanted = []
    for i, t, _ in texts:
        (s,) = Q.apply(model, np.array([sizes.measure((t or "").encode())]))
        wanted.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(float(s), 9), int(s >= 0.3)))
    got = [(str(a), b, round(s, 9), p) for a, b, s, p in map(tuple, Q.op3_quality(spark, str(tmp_path)).collect())]
    assert sorted(got) == sorted(wanted)

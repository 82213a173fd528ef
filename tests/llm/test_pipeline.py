"""The pipeline against brute force, stage by stage, on a small corpus."""

import random

import numpy as np
import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from phylospark.llm import quality  # noqa: E402
from tests.llm.test_decontamination import plain as plain_hits  # noqa: E402
from tests.llm.test_quality import corpus  # noqa: E402
from tests.llm.test_sharding import plain_jump  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    r = random.Random(8)
    rows = [(i, t, "en", f"src{i % 3}" if i % 10 else None, len(t)) for i, t, _ in corpus(300)]
    words = [w for _, t, *_ in rows for w in t.split()]
    items = [(k, " ".join(r.choice(words) for _ in range(14))) for k in range(5)]
    for k in range(12):  # copies, near copies and passages
        rows.append((400 + k, rows[k][1], "en", "src0", rows[k][4]))
        rows.append((500 + k, rows[k][1] + " end", "en", "src1", rows[k][4] + 4))
        rows.append((600 + k, rows[20 + k][1] + " " + items[k % 5][1], "en", "src2", 1))
    rows += [rows[5], rows[5], (None, None, None, None, None), (800, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in corpus(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_stage(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    kept = stages["quality"](spark, docs, folder).cache()
    assert kept.columns == columns
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality.apply(model, np.array([quality.Sizes(model.good, model.bad).measure((r["text"] or "").encode()) for r in docs.collect()]))
    assert rows_of(kept) == sorted((tuple(r) for r, s in zip(docs.collect(), scores, strict=True) if s >= quality.THRESHOLD), key=str)

    single = stages["near_duplicates"](spark, kept, folder).cache()
    own = sorted({tuple(r) for r in kept.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    root = plain_components([plain_fingerprint(r[1] or "") for r in own])
    assert single.columns == columns
    assert rows_of(single) == sorted((r for i, r in enumerate(own) if root[i] == i), key=str)

    clean = stages["decontamination"](spark, single, folder).cache()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = [tuple(r) for r in single.collect()]
    assert clean.columns == columns and clean.count() < len(before)
    assert rows_of(clean) == sorted((r for r, h in zip(before, plain_hits([r[1] for r in before], items), strict=True) if not h[1]), key=str)

    mixed = stages["mixing"](spark, clean, folder).cache()
    assert mixed.columns == columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    size = lambda t: len((t or "").split())
    by_source = {}
    for r in clean.collect():
        total, taken = by_source.get(r["source"], (0, 0))
        by_source[r["source"]] = total + size(r["text"]), taken + size(r["text"]) * times.get(r["doc_id"], 0)
        assert times.get(r["doc_id"], 0) <= 2
    longest = max(size(r["text"]) for r in clean.collect())
    total = sum(n for n, _ in by_source.values())
    assert abs(sum(t for _, t in by_source.values()) - 1.5 * total) <= longest * len(by_source)

    last = stages["sharding"](spark, mixed, folder)
    assert last.columns == [*columns, "shard"] and last.count() == mixed.count()
    key = lambda i: xxhash.xxh64_intdigest("null" if i is None else str(i), 42)
    assert all(r["shard"] == plain_jump(key(r["doc_id"]), 16) for r in last.collect())


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert rows_of(got) == rows_of(docs)


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_documents_that_share_an_id(spark, folder):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite other words than those above"), (2, "a b c d e f"), (3, "third")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, folder)
    assert rows_of(got) == sorted([(1, "a b c d e f", "x"), (1, "quite other words than those above", "x"), (3, "third", "x")], key=str)

import zlib

import numpy as np

from phylospark.llm import sharding as S


def plain_jump(key: int, shards: int) -> int:
    """One key at a time, in whole numbers of any size."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * S.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert S.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_one_more_shard_takes_its_part_only():
    keys = np.arange(50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before, after = S.jump_hash(keys, 16), S.jump_hash(keys, 17)
    moved = before != after
    assert (after[moved] == 16).all() and abs(moved.mean() - 1 / 17) < 0.01


def test_slots_are_gapless_whatever_the_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SPREAD", 7)
    rows = [(i % 40, f"t{i % 40}") for i in range(200)] + [(7, "hot")] * 300 + [(None, None)] * 5
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got = S.assign_shards(docs, "doc_id", 4, ["text"], bucket_rows=3).collect()
    assert len(got) == len(rows)
    for n in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == n)
        assert own == list(range(len(own)))
    assert {r["grown_shard"] for r in got} - {r["shard"] for r in got} <= {4}
    again = S.assign_shards(docs.repartition(7), "doc_id", 4, ["text"], bucket_rows=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert S.assign_shards(docs.limit(0), "doc_id", 4).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "é a"), (2, None), (3, ""), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in S.op5_sharding(spark, str(tmp_path)).collect())
    assert got == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t in rows)
    assert dict(S.op5_sharding(spark, str(tmp_path)).dtypes)["slot"] == "bigint"

import duckdb
import pytest

from phylospark.llm import mixing as M


def test_water_filling():
    got = M.targets([("a", 100), ("b", 100), ("c", 100)], (3, 1, 2), 1.5, 2)
    assert got["a"] == 200 and sum(got.values()) == pytest.approx(450) and got["c"] == pytest.approx(2 * got["b"])
    assert M.targets([("a", 0), ("b", 10)], (3, 1), 1.5, 2) == {"a": 0.0, "b": pytest.approx(15)}
    assert M.targets([], (3, 1), 1.5, 2) == {}


def tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(str, (tuple(r) for r in M.op7_mixing(spark, str(tmp_path)).collect())))
    return got, sorted(str((a, b, c, d, e)) for a, b, c, d, e in con.execute(M.OP7_SQL).fetchall())


def test_equals_sql_with_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(i, "w " * (i % 17) if i % 11 else None, ["x", "y", None, "é", "hot", "hot", "hot"][i % 7], 0) for i in range(400)]
    rows += [(5, "w w w", "x", 0)] * 3 + [(None, "a\tb\nc d", None, 0), (None, None, "empty source", 0), (900, "w " * 5000, "hot", 0)]
    got, wanted = tables(spark, tmp_path, rows)
    assert got == wanted


def test_empty_table(spark, tmp_path):
    assert tables(spark, tmp_path, []) == ([], [])


def test_budgets_are_nested(spark):
    rows = spark.createDataFrame([("a", 1 + i % 5, (i * 7919) % 2**20 << 40) for i in range(500)], "skey string, size long, h long")
    last = [M.thresholds(rows, {"a": b})["a"] for b in (0, 10, 400, 1000, 1500, 9999)]
    assert last == sorted(last) and last[0] == -1 and last[-1] == 2**60 - 1
    own = [(r["size"], r["h"]) for r in rows.collect()]
    for b, t in zip((10, 400, 1000), last[1:], strict=False):
        assert abs(sum(s for s, h in own if h <= t) - b) <= 5


def test_too_many_sources(spark):
    docs = spark.createDataFrame([(i, "w", str(i)) for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        M.plan_mix(docs, "doc_id", "text", "source", max_sources=4)


@pytest.mark.parametrize("alike", [False, True])
def test_a_key_with_most_rows_is_split(spark, tmp_path, alike):
    """Rows of one key and source, with different texts or none but alike ones, still come near the target."""
    rows = [(7, "w " * 10 if alike else f"t{i} " + "w " * 9, "x", 0) for i in range(200)] + [(i, "w " * 10, "y", 0) for i in range(300, 400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    runs = [sorted(map(tuple, M.op7_mixing(spark, str(tmp_path)).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 300
    for size in (2000, 1000):
        own = [r for r in runs[0] if r[2] == size]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 10 and all(r[4] in (0, 10, 20) for r in own)


def test_very_long_text(spark, tmp_path):
    got, wanted = tables(spark, tmp_path, [(1, "word " * 300_000, "x", 0), (2, "a b", "x", 0), (3, "a", "y", 0)])
    assert got == wanted

import pyarrow as pa

from phylospark.llm import _shared as S


def test_slices_keep_all_rows_in_order():
    sizes = [0, 5, 9, None, 30, 1, 1, 1, 12]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], ["i", "t"])
    parts = list(S.slices(iter([batch, batch.slice(0, 0)]), "t", limit=10))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(9))
    assert all(p.num_rows == 1 or sum(len(t or b"") for t in p.column("t").to_pylist()) <= 10 for p in parts)


def test_fresh_names_ignore_case(spark):
    df = spark.createDataFrame([(1, 2)], "__FP int, x int")
    assert S.fresh(df, "fp") == "__fp_" and S.fresh(df, "y") == "__y"


def test_staged_tables_keep_schema_and_can_be_dropped(spark):
    df = spark.createDataFrame([(1, [b"a"], None)], "a int, b array<binary>, c string")
    staged = S.stage(df, "test")
    assert staged.schema == df.schema and staged.collect() == df.collect()
    assert staged._phylospark_path.startswith(S.shared_dir(spark))
    S.discard(staged)

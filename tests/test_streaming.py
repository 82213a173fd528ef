import datetime as dt

from phylospark.operators.timing import Timings
from phylospark.streaming import generations


def events(spark, folder):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=5 * i), i % 3, "a" if i % 2 else "b", float(i)) for i in range(40)]
    own = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    own.coalesce(1).write.parquet(str(folder / "events.parquet"))
    return own


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    own = events(spark, tmp_path)
    stream = generations.read_stream(spark, str(tmp_path / "events.parquet"), "*.parquet", own.schema)
    for name, step in (("buckets", generations.bucket_counts), ("sessions", generations.sessions)):
        query = step(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, step(own).collect()))


def test_timings(spark):
    timings = Timings()
    for _ in range(2):
        with timings("step"):
            pass
    assert timings.table(spark).count() == 2 and all(n >= 0 for n in timings.durations["step"])

import datetime as dt

from pyspark.sql import functions as F

from tarn.streaming import drain, session_counts, sliding_counts, tumbling_counts

DAY = dt.datetime(2024, 3, 1, 10)


def events(spark, path, minutes):
    rows = [(DAY + dt.timedelta(minutes=m), "a" if m % 2 else "b") for m in minutes]
    spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("ts timestamp_ntz, kind string").option("maxFilesPerTrigger", 1).parquet(path)


def test_a_drained_stream_equals_the_batch(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    events(spark, path, [0, 2, 5, 12, 13, 29, 30, 48])
    batch = spark.read.parquet(path)
    for k, count in enumerate((lambda d: tumbling_counts(d, "10 minutes", ["kind"]), lambda d: sliding_counts(d, "10 minutes", "5 minutes", []), lambda d: session_counts(d, "6 minutes", ["kind"]))):
        want, got = count(batch), drain(count(stream(spark, path)), f"file://{tmp_path}/out{k}", "append" if k == 2 else "complete")
        assert got.dtypes == want.dtypes
        if k < 2:
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        else:  # a session is written once the watermark has passed its end
            assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want.where(F.col("start") < F.lit(DAY + dt.timedelta(minutes=40))).collect())


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for minutes in ([1, 2], [120], [121], [3], [240]):
        events(spark, path, minutes)
    got = drain(tumbling_counts(stream(spark, path), "10 minutes", []), out)
    counts = {r["start"]: r["n"] for r in got.collect()}
    assert counts[DAY] == 2 and counts[DAY + dt.timedelta(minutes=120)] == 2

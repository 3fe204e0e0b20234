import datetime

import pytest
from pyspark.sql import functions as F

from quillon.operators import concepts
from quillon.streaming import jobs


def stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_smoothing_keeps_state_between_batches(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    schema = "k string, ts timestamp, v double"
    s = stream(spark, str(tmp_path), [[("a", t, 1.0), ("a", t + datetime.timedelta(1), 2.0), ("b", t, None)], [("a", t + datetime.timedelta(2), 4.0)]], schema)
    q = jobs.smoothed(s, "k", "v", 0.5).writeStream.outputMode("update").format("memory").queryName("ema").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    state = 0.0
    for v in (1.0, 2.0, 4.0):
        state += (v - state) * 0.5
    assert spark.table("ema").filter("k = 'a' AND n = 3").first().ema == pytest.approx(state)


def test_online_coactivation_is_a_moving_average(spark, tmp_path):
    schema = "id bigint, unit int, value double, phase string"
    first = spark.createDataFrame([(1, 0, 3.0, "train"), (1, 1, 4.0, "train"), (9, 0, 1.0, "val")], schema)
    second = spark.createDataFrame([(2, 1, 1.0, "train")], schema)
    memory = jobs.OnlineCoactivation(str(tmp_path / "state"), momentum=0.1)
    memory.merge(first, 0)
    memory.merge(second, 1)
    memory.merge(second.filter("id > 5"), 2)
    got = {(r.i, r.j): r.c for r in memory.state(spark, 2).collect()}
    assert got[0, 0] == pytest.approx(0.9 * 0.1 * 0.36, rel=1e-6)
    assert got[0, 1] == pytest.approx(0.9 * 0.1 * 0.48, rel=1e-6)
    assert got[1, 1] == pytest.approx(0.9 * 0.1 * 0.64 + 0.1, rel=1e-6)


def test_stages_log_in_order_and_errors_end_a_batch(spark, tmp_path):
    s = stream(spark, str(tmp_path), [[(1,)], [(2,)]], "id bigint")

    def fail_on_two(df):
        return df.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("two"))).otherwise(F.lit("")))

    jobs.run_stages(s, [("load", lambda df: df), ("check", fail_on_two)], str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    said = list(jobs.followed(spark, str(tmp_path / "log"), poll=0.01))
    assert said[-1][0] in ("done", "error") and ("load", "ok") in said
    assert list(jobs.followed(spark, str(tmp_path / "none"), poll=0.01, most=0.05)) == []
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {r.stage for r in log.filter("message = 'ok'").collect()} == {"load", "check"}
    assert log.filter("stage = 'error'").count() == 1 and log.filter("stage = 'done'").count() == 1


def test_windowed_counts(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    s = stream(spark, str(tmp_path), [[(t, "a"), (t, "a"), (t + datetime.timedelta(hours=5), "b")]], "ts timestamp, kind string")
    q = jobs.windowed_counts(s, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("wc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.kind, r.n) for r in spark.table("wc").collect()} == {("a", 2), ("b", 1)}


def test_normalized_length(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 4.0)], "id bigint, q double")
    assert sorted(r.a for r in concepts.normalized(df, "id", "q", "a").collect()) == pytest.approx([0.6, 0.8])

"""Stateful operators on streams: keyed smoothing, online co-activation, progress of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concepts


def smoothed(stream: DataFrame, key: str, value: str, alpha: float = 0.2) -> DataFrame:
    """(key, ema, n) per key and micro-batch: an average that starts at zero and keeps its state between batches.

    Rows are folded in the order of ``ts``, then of the value; null values are passed over.
    """
    kind = dict(stream.dtypes)[key]

    def fold(found, batches, state):
        import pandas as pd

        ema, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat([b.dropna(subset=[value]) for b in batches]).sort_values(["ts", value])
        for x in rows[value]:
            ema, n = ema + (float(x) - ema) * alpha, n + 1
        state.update((ema, n))
        yield pd.DataFrame({key: [found[0]], "ema": [ema], "n": [n]})

    return stream.select(key, "ts", value).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, ema double, n bigint", "ema double, n bigint", "update", "NoTimeout")


class OnlineCoactivation:
    """Co-activation as a moving average over micro-batches: order-dependent, so each batch is merged into a state table.

    ``path`` holds two versions in turn; the newest with a marker is the state, so a batch that is lost leaves the old one.
    Rows with ``phase`` other than train are observed but never learned from.
    """

    def __init__(self, path: str, momentum: float = 0.1):
        self.path, self.momentum = path, momentum

    def _slot(self, batch: int) -> str:
        return f"{self.path}/slot_{batch % 2}"

    def state(self, spark, batch: int) -> DataFrame:
        try:
            return spark.read.parquet(self._slot(batch))
        except Exception as error:  # the first batch has no state before it
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], "i bigint, j bigint, c double")

    def merge(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: rows (id, unit, value, phase)."""
        spark = rows.sparkSession
        train = rows.filter("phase = 'train' AND value IS NOT NULL")
        old = self.state(spark, batch - 1)
        if train.isEmpty():
            merged = old
        else:
            summed = train.groupBy("id", "unit").agg(F.sum("value").alias("q"))
            now = concepts.coactivation(concepts.normalized(summed, "id", "q", "a"), "id", "unit", "a")
            both = old.withColumnRenamed("c", "before").join(now.withColumnRenamed("c", "after"), ["i", "j"], "full")
            merged = both.select("i", "j", ((1 - self.momentum) * F.coalesce("before", F.lit(0.0)) + self.momentum * F.coalesce("after", F.lit(0.0))).alias("c"))
        merged.write.mode("overwrite").parquet(self._slot(batch))


def run_stages(jobs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], log: str, checkpoint: str):
    """Stream of jobs through named stages; every stage adds a row (batch, stage, message) to the log table.

    A stage that fails ends its batch with the row ``error`` and its message.
    """

    def work(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        said = []
        try:
            for name, stage in stages:
                rows = stage(rows)
                said.append((batch, name, "ok"))
            rows.write.format("noop").mode("overwrite").save()
            said.append((batch, "done", str(len(stages))))
        except Exception as error:
            said.append((batch, "error", str(error)[:500]))
        spark.createDataFrame(said, "batch bigint, stage string, message string").coalesce(1).write.mode("append").parquet(log)

    return jobs.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark, log: str, poll: float = 0.15, most: float = 600.0):
    """The messages (stage, message) of a job's log as they come in, batch by batch; ends with done or error, or after ``most`` seconds."""
    import time

    seen, until = set(), time.monotonic() + most
    while time.monotonic() < until:
        try:
            rows = spark.read.schema("batch bigint, stage string, message string").parquet(log).collect()  # a few rows a batch
        except Exception as error:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = []
        for r in sorted((r for r in rows if r not in seen), key=lambda r: (r.batch, r.stage in ("done", "error"))):
            seen.add(r)
            yield r.stage, r.message
            if r.stage in ("done", "error"):
                return
        time.sleep(poll)


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Engine extra: counts per time window and kind with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))

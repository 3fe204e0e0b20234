"""Percentiles from cumulative frequencies, for groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .positions import checkpointed, shuffle_width


def level_name(level: float) -> str:
    return f"p{round(level * 100):02d}"


def frequencies(values: DataFrame, groups: list[str], value: str, relative_error: float | None = None) -> DataFrame:
    """State of the operator: ``groups``, ``value`` and ``n``, one row for each different value of a group.

    With ``relative_error`` values are merged into logarithmic cells, all of whose values are within it of the cell's.
    """
    v = F.col(value)
    if relative_error:
        width = math.log1p(relative_error) * 2
        cell = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.exp(F.round(F.log(F.abs(v)) / width) * width))
        values = values.withColumn(value, cell)
    else:
        values = values.withColumn(value, F.when(v == 0, F.lit(0.0)).otherwise(v))  # -0.0 and 0.0 are one value
    return values.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def _changes(batch, at: list[int], last: tuple | None):
    """Where the group of a batch's rows differs from that of the row before."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    starts = np.zeros(n, bool)
    for i in at:
        column = batch.column(i)
        a, b = column.slice(1), column.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        starts[1:] |= pc.or_(differs, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    starts[0] = last is None or tuple(batch.column(i)[0].as_py() for i in at) != last
    return starts


def percentiles(state: DataFrame, groups: list[str], value: str, levels, at_least: int = 1) -> DataFrame:
    """``groups``, ``n`` and one column ``pXX`` for each level, linear between the two nearest ranks, of the groups with
    ``at_least`` values.  ``state`` is of ``frequencies``; its values are finite.

    The state is sorted by range over all partitions.  A group goes on into other partitions only where it is the first or
    last of one, so two sums of each partition give all offsets, and those are what is gathered and sent.  The running
    sums, the offset and the first values that reach the target ranks are then found inside each partition; what is
    shuffled again is one row of picks for a group and partition.
    """
    spark = state.sparkSession
    order = [F.col(g).asc() for g in groups] + [F.col(value).asc()]
    state = state.select(*groups, F.col(value).cast("double").alias(value), F.col("n").cast("bigint").alias("n"))
    pieces = state.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    pieces = checkpointed(pieces.withColumn("_pid", F.spark_partition_id()))
    at, v, n, p = list(range(len(groups))), len(groups), len(groups) + 1, len(groups) + 2
    kinds = [T.StructField(f.name, f.dataType, True) for f in state.schema.fields[: len(groups)]]

    def ends(batches):
        import pyarrow as pa

        first, total, last, pid, proto = None, 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            proto, pid = batch.schema, batch.column(p)[0].as_py()
            starts = _changes(batch, at, last).nonzero()[0]
            count = batch.column(n).to_numpy()
            if len(starts):
                if last is not None and first is None:
                    first = (last, total + int(count[: starts[0]].sum()))
                if first is None and len(starts) > 1:
                    first = (tuple(batch.column(i)[int(starts[0])].as_py() for i in at), int(count[starts[0] : starts[1]].sum()))
                total = int(count[starts[-1] :].sum())
            else:
                total += int(count.sum())
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in at)
        if proto is not None:
            rows = ([(*first, 0)] if first is not None else []) + [(last, total, 1)]
            columns = [pa.array([k[i] for k, _, _ in rows], proto.field(i).type) for i in at]
            columns += [pa.array([pid] * len(rows), pa.int32()), pa.array([w for _, _, w in rows], pa.int32()), pa.array([s for _, s, _ in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*groups, "_pid", "_last", "_sum"])

    schema = T.StructType([*kinds, T.StructField("_pid", T.IntegerType()), T.StructField("_last", T.IntegerType()), T.StructField("_sum", T.LongType())])
    book = sorted(pieces.mapInArrow(ends, schema).collect(), key=lambda r: (r["_pid"], r["_last"]))  # two rows a partition, at most
    offsets, run = {}, []

    def close():
        total = sum(r["_sum"] for r in run)
        before = 0
        for r in run:
            offsets[r["_pid"], r["_last"]] = (before, total)
            before += r["_sum"]
        run.clear()

    for r in book:
        if run and tuple(run[-1][g] for g in groups) != tuple(r[g] for g in groups):
            close()
        run.append(r)
    close()
    shared = spark.sparkContext.broadcast(offsets)

    def pick(batches):
        import numpy as np
        import pyarrow as pa

        last, pid, named, values, counts, starts = None, None, [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(p)[0].as_py()
            here = _changes(batch, at, last)
            named.append(batch.select(at).take(pa.array(here.nonzero()[0])) if at else batch.select([v]).slice(0, int(here.sum())))
            values.append(batch.column(v).to_numpy())
            counts.append(batch.column(n).to_numpy())
            starts.append(here)
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in at)
        if pid is None:
            return
        values, begin = np.concatenate(values), np.concatenate(starts).nonzero()[0]
        upto = np.cumsum(np.concatenate(counts))
        base = np.concatenate([[0], upto])[begin]
        own = np.diff(np.append(base, upto[-1]))
        before, total = np.zeros(len(begin), "int64"), own.copy()
        for which, place in ((0, 0), (1, len(begin) - 1)):
            if (pid, which) in shared.value:
                before[place], total[place] = shared.value[pid, which]
        picks = []
        for level in levels:
            rank = (total - 1) * float(level)
            for target in (np.floor(rank).astype("int64"), np.ceil(rank).astype("int64")):
                inside = (target >= before) & (target < before + own)
                hit = np.searchsorted(upto, base + np.where(inside, target - before, 0), side="right")
                picks.append(pa.array(values[hit], mask=~inside))
        keys = pa.Table.from_batches(named).combine_chunks()
        columns = [keys.column(i).combine_chunks() for i in at]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total), *picks], names=[*groups, "n", *names])

    names = [f"_{side}{i}" for i in range(len(levels)) for side in "lh"]
    schema = T.StructType([*kinds, T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    picked = pieces.mapInArrow(pick, schema).groupBy(*groups).agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in names]).filter(F.col("n") >= at_least)
    out = [F.col(g) for g in groups] + [F.col("n")]
    for i, level in enumerate(levels):
        rank = (F.col("n") - 1) * F.lit(float(level))
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (rank - F.floor(rank))).alias(level_name(level)))
    return picked.select(*out)


def exact_percentiles(df: DataFrame, groups: list[str], value: str, levels) -> DataFrame:
    """``percentiles`` of the finite values of a column; null, NaN and infinite ones do not count."""
    v = F.col(value)
    fine = df.filter(v.isNotNull() & ~F.isnan(value) & (F.abs(v) < float("inf"))).select(*groups, v.cast("double").alias(value))
    return percentiles(frequencies(fine, groups, value), groups, value, levels)

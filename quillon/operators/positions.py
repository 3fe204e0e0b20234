"""Places in an order, for groups of any size, and the cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the folder named by ``spark.checkpoint.dir``.

    The result is read as a plain table of rows: a checkpoint would keep the size estimate of the plan it came
    from, and as joins multiply estimates, these would double their digits with every round of an iterative job.
    Files of rounds that no plan refers to any more are deleted where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``session.session`` does.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    try:
        rows = kept._jdf.queryExecution().toRdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    except (AttributeError, TypeError, Py4JError):  # no classic session behind this one
        return kept


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  A local session (tests, notebooks) that names none gets one of this machine.

    On a cluster a folder of the driver's machine would be written where nobody else can read, so there is none.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir names no folder; on a cluster it must name one that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for tables that one query writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"


#: Keys that hold more than one in so many rows are hot; there can be no more of them than that.
HOT_KEYS = 1000
#: Below so many rows a hot key is no burden for one task.
FEW_ROWS = 2_000_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` where one key may hold any share of ``left``; ``right`` has one row a key.

    The keys are not null.  Hot keys, fewer than HOT_KEYS by their definition, are joined with their broadcast rows
    of ``right`` where they lie; the rest is shuffled.  ``rows``, the size of ``left``, spares that where it is small.
    """
    if rows is not None and rows < FEW_ROWS:
        return left.join(right, on, how)
    total = left.agg(F.count(F.lit(1)).alias("_total"))
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(total)).filter(F.col("_n") * HOT_KEYS > F.col("_total")).select(*on)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    few = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    rest = marked.filter("_hot IS NULL").drop("_hot").join(right, on, how)
    return marked.filter("_hot").drop("_hot").join(few, on, how).unionByName(rest)


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 2)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))


def local_positions(df: DataFrame, group: str, order: list[Column], keep: int | None = None, weight: str | None = None) -> DataFrame:
    """Range-sort ``df`` by ``group`` and ``order`` over all partitions and number the rows inside each partition, or
    sum up their ``weight``, a bigint.

    ``group`` must not be null.  Adds ``_pid`` and ``_rank`` (from 1 inside partition and group).  With ``keep``,
    rows whose place in the partition is already beyond it are left out, as their place in the whole is no
    better.  A group that ends in a partition cannot go on in a later one, so each partition adds a single row
    of bookkeeping: the last group and its count there in ``_count`` (null for ordinary rows).
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    at = df.columns.index(group)
    heavy = None if weight is None else df.columns.index(weight)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    schema = schema.add("_pid", T.IntegerType()).add("_rank", T.LongType()).add("_count", T.LongType())

    def number(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, seen, proto = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            proto = batch.schema
            keys = batch.column(at)
            starts = np.ones(n, dtype=bool)
            starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts[0] = keys[0].as_py() != last
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, place, -1))
            if weight is None:
                rank = np.where(begin < 0, seen + place + 1, place - begin + 1)
            else:
                upto = np.concatenate([[0], np.cumsum(batch.column(heavy).to_numpy())])
                rank = np.where(begin < 0, seen + upto[1:], upto[1:] - upto[np.maximum(begin, 0)])
            last, seen = keys[n - 1].as_py(), int(rank[-1])
            if keep is not None:
                chosen = rank <= keep
                batch, rank = batch.filter(pa.array(chosen)), rank[chosen]
            n = batch.num_rows
            if n:
                extra = [pa.array(np.full(n, pid, dtype="int32")), pa.array(rank.astype("int64")), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(batch.columns + extra, names=[*proto.names, "_pid", "_rank", "_count"])
        if proto is not None:
            row = [pa.array([last], f.type) if i == at else pa.nulls(1, f.type) for i, f in enumerate(proto)]
            row += [pa.array([pid], pa.int32()), pa.nulls(1, pa.int64()), pa.array([seen], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, names=[*proto.names, "_pid", "_rank", "_count"])

    return ranged.mapInArrow(number, schema)


def with_position(df: DataFrame, group: str, order: list[Column], name: str = "position", total: str | None = None, weight: str | None = None) -> DataFrame:
    """Exact place of every row in its group by ``order``, from 1, for groups of any size; with ``total``, its size too.

    With ``weight`` it is the sum of the weights up to and with the row instead.

    The offsets number at most two per partition, so they are the one side that is broadcast.
    """
    local = checkpointed(local_positions(df, group, order, weight=weight))
    rows = local.filter(F.col("_count").isNull()).drop("_count")
    counts = local.filter(F.col("_count").isNotNull()).select(F.col(group).alias("_pos_group"), F.col("_pid").alias("_pos_part"), "_count")
    # a group goes on from the partition it ends in to the next one that is not empty, and no further
    along = Window.partitionBy("_pos_group").orderBy("_pos_part")
    counts = counts.withColumn("_pos_next", F.lead("_pos_part").over(Window.orderBy("_pos_part"))).withColumn("_pos_last", F.lead("_pos_part").over(along).isNull())
    counts = counts.withColumn("_pos_upto", F.sum("_count").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.struct(F.col("_pos_part").alias("_pos_at"), (F.col("_pos_upto") - F.col("_count")).alias("_pos_before"))
    after = F.struct(F.col("_pos_next").alias("_pos_at"), F.col("_pos_upto").alias("_pos_before"))
    offsets = counts.select("_pos_group", F.inline(F.filter(F.array(here, F.when(F.col("_pos_last") & F.col("_pos_next").isNotNull(), after)), lambda x: x.isNotNull())))
    joined = rows.join(F.broadcast(offsets), (F.col(group) == F.col("_pos_group")) & (F.col("_pid") == F.col("_pos_at")), "left")
    placed = joined.withColumn(name, F.col("_rank") + F.coalesce("_pos_before", F.lit(0)))
    if total is None:
        return placed.select(*df.columns, name)
    sizes = rows.groupBy(F.col(group).alias("_pos_whole")).agg(F.count(F.lit(1)).alias(total))
    return placed.join(sizes, F.col(group) == F.col("_pos_whole")).select(*df.columns, name, total)


def top_positions(df: DataFrame, group: str, order: list[Column], n: int, name: str = "position") -> DataFrame:
    """Rows of the first ``n`` places of every group: local places plus prefix sums over the partitions.

    After the local cut a group has at most ``n`` rows and one bookkeeping row per partition it spans.
    """
    local = local_positions(df, group, order, keep=n)
    earlier = Window.partitionBy(group).orderBy("_pid").rangeBetween(Window.unboundedPreceding, -1)
    placed = local.withColumn(name, F.col("_rank") + F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    return placed.filter(F.col("_count").isNull() & (F.col(name) <= n)).select(*df.columns, name)


def last_known(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` of the group that is not null, up to and with the row, for groups of any size.

    ``group`` must not be null, ``value`` is boolean.  Rows are sorted by range over all partitions and carried on inside each; what a partition
    ends with is one row, and where a group goes on over partitions the last known of these is looked up.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    at, seen_at = df.columns.index(group), df.columns.index(value)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    schema = schema.add("_pid", T.IntegerType()).add("_known", T.BooleanType()).add("_ends", T.BooleanType())

    def carry(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid, last, state, proto = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            proto, keys, own = batch.schema, batch.column(at), batch.column(seen_at)
            starts = np.ones(n, bool)
            starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts[0] = keys[0].as_py() != last
            given, place = own.is_valid().to_numpy(zero_copy_only=False), np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, place, -1))
            source = np.maximum.accumulate(np.where(given, place, -1))
            source = np.where(source >= begin, source, -1)
            here = (source >= 0) & (given[np.maximum(source, 0)])
            known = pa.array(np.where(here, np.array(pc.fill_null(own, False).to_numpy(zero_copy_only=False), bool)[np.maximum(source, 0)], bool(state)), mask=~(here | ((begin < 0) & (state is not None))))
            last, state = keys[n - 1].as_py(), known[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, "int32")), known, pa.nulls(n, pa.bool_())], names=[*proto.names, "_pid", "_known", "_ends"])
        if proto is not None:
            row = [pa.array([last], f.type) if i == at else pa.nulls(1, f.type) for i, f in enumerate(proto)]
            row += [pa.array([pid], pa.int32()), pa.array([state], pa.bool_()), pa.array([True])]
            yield pa.RecordBatch.from_arrays(row, names=[*proto.names, "_pid", "_known", "_ends"])

    carried = checkpointed(ranged.mapInArrow(carry, schema))
    ends = carried.filter("_ends").select(F.col(group).alias("_pos_group"), F.col("_pid").alias("_pos_part"), F.col("_known").alias("_pos_known"))
    ends = ends.withColumn("_pos_next", F.lead("_pos_part").over(Window.orderBy("_pos_part")))  # one row a partition
    along = Window.partitionBy("_pos_group").orderBy("_pos_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_pos_before", F.last("_pos_known", ignorenulls=True).over(along)).select("_pos_group", F.col("_pos_next").alias("_pos_at"), "_pos_before").filter("_pos_at IS NOT NULL")
    rows = carried.filter("_ends IS NULL").drop("_ends")
    joined = rows.join(F.broadcast(ends), (F.col(group) == F.col("_pos_group")) & (F.col("_pid") == F.col("_pos_at")), "left")
    return joined.withColumn(name, F.coalesce("_known", "_pos_before")).select(*df.columns, name)

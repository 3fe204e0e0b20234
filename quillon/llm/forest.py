"""Connected components by Borůvka contraction: every round each component takes its smallest outgoing edge.

Edges are ordered by the components they join, the smaller far end first.  The edges taken are a spanning forest of
the whole graph, which ``write_forest`` keeps as a table.  Nothing is gathered on the driver but row counts; each
round at least halves the number of components that still have edges, and its tables are written to the checkpoint
folder, so neither lineage nor an executor's memory carries the state.  A vertex of any degree is combined before it
is sent, and where its component's id would be one task's join key, ``join_hot`` takes it out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot


def _lifted(hooked: DataFrame, rows: int) -> DataFrame:
    """Parents of parents, twice: (u, p, moved), ``moved`` where the last step still changed the parent."""
    up = hooked.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    once = join_hot(hooked, up, ["p"], rows=rows).select("u", F.col("pp").alias("p"))
    return join_hot(once, up, ["p"], rows=rows).select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(a, b)`` of bigints to (labels, forest).

    labels(v, root): one row per vertex that has an edge to another vertex, root being the smallest vertex of
    its component.  forest(a, b): a spanning forest, a < b, of one edge fewer than vertices in each component.
    Null ends, loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    clean = clean.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    left = checkpointed(clean.select("u", "v", F.col("u").alias("lo"), F.col("v").alias("hi")))
    forest = spark.createDataFrame([], "a bigint, b bigint")
    labels, rows = None, left.count()
    vertices = 2 * rows  # at most
    while rows:
        ends = left.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        best = ends.groupBy("u").agg(F.min("v").alias("p"))
        # the order is total, so the only cycles are two components that take the same edge: the smaller is the root
        pairs = best.groupBy(F.least("u", "p").alias("x"), F.greatest("u", "p").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"))
        pairs = checkpointed(pairs)
        other = F.when(F.col("u") == F.col("x"), F.col("y")).otherwise(F.col("x"))
        twice = F.array(F.struct(F.col("x").alias("u"), F.col("x").alias("p")), F.struct(F.col("y").alias("u"), F.col("x").alias("p")))
        hooked = pairs.select(F.inline(F.when(F.col("n") == 2, twice).otherwise(F.array(F.struct("u", other.alias("p"))))))
        taken = pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).join(left, ["u", "v"])
        forest = forest.unionByName(taken.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        moved = True
        while moved:
            lifted = checkpointed(_lifted(hooked, 2 * rows))
            moved = not lifted.filter("moved").isEmpty()
            hooked = lifted.select("u", "p")
        if labels is None:
            labels = hooked.select(F.col("u").alias("v"), F.col("p").alias("root"))
        else:
            up = hooked.select(F.col("u").alias("root"), F.col("p").alias("higher"))
            labels = join_hot(labels, up, ["root"], "left", vertices).select("v", F.coalesce("higher", "root").alias("root"))
        kept = join_hot(left, hooked.select("u", F.col("p").alias("ru")), ["u"], rows=rows)
        kept = join_hot(kept, hooked.select(F.col("u").alias("v"), F.col("p").alias("rv")), ["v"], rows=rows).filter("ru <> rv")
        kept = kept.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"), "lo", "hi")
        left = checkpointed(kept.dropDuplicates(["u", "v"]))
        rows = left.count()
    if labels is None:
        return spark.createDataFrame([], "v bigint, root bigint"), forest
    labels = checkpointed(labels)
    return join_hot(labels, labels.groupBy("root").agg(F.min("v").alias("least")), ["root"], rows=vertices).select("v", F.col("least").alias("root")), forest


def write_forest(forest: DataFrame, path: str) -> DataFrame:
    """The forest kept as a table, each edge once, and read from there."""
    forest.write.mode("overwrite").parquet(path)
    return forest.sparkSession.read.parquet(path)

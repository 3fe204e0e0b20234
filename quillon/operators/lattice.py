"""Operators on the nodes of three-dimensional lattices, one lattice per bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def nodes(rows: DataFrame) -> DataFrame:
    """One row per node with flat coordinates."""
    flat = rows.select("node_id", "bundle_id", "idx", F.col("grid.z").alias("z"), F.col("grid.y").alias("y"), F.col("grid.x").alias("x"), "hits", "umatrix", "community", "dead", "weight")
    return flat.dropDuplicates(["node_id"])


def steps(connectivity: int = 6) -> list[tuple[int, int, int]]:
    """Half of the neighbour offsets, so that each undirected edge is met once."""
    every = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return [s for s in every if s > (0, 0, 0) and (connectivity == 26 or sum(map(abs, s)) == 1)]


def edges(nodes: DataFrame, connectivity: int = 6) -> DataFrame:
    """(bundle_id, a, b): a before b in lattice order; an equi-join on the coordinates each offset leads to."""
    offsets = F.array(*[F.struct(F.lit(z).alias("dz"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for z, y, x in steps(connectivity)])
    out = nodes.select("bundle_id", F.col("node_id").alias("a"), "z", "y", "x", F.explode(offsets).alias("s"))
    out = out.select("bundle_id", "a", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return out.join(nodes.select("bundle_id", "z", "y", "x", F.col("node_id").alias("b")), ["bundle_id", "z", "y", "x"]).select("bundle_id", "a", "b")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("bundle_id", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def with_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the distance of their ends' weight vectors."""
    left = nodes.select(F.col("node_id").alias("a"), F.col("weight").alias("wa"))
    right = nodes.select(F.col("node_id").alias("b"), F.col("weight").alias("wb"))
    return edges.join(left, "a").join(right, "b").select("bundle_id", "a", "b", F.sqrt(V.squared_distance(F.col("wa"), F.col("wb"))).alias("distance"))


def umatrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, u): mean distance to the lattice neighbours, 0 for an isolated node."""
    measured = with_weights(edges, nodes)
    ends = measured.select(F.inline(F.array(F.struct(F.col("a").alias("node_id"), "distance"), F.struct(F.col("b").alias("node_id"), "distance"))))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.avg("distance").alias("u")), "node_id", "left").select("node_id", F.coalesce("u", F.lit(0.0)).alias("u"))

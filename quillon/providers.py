"""Seams: models, graphs, concepts, labels and analyzers that a user may put in place of the library's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """What a pack says of the model behind it."""

    arch: str
    patch_size: int = 16
    num_layers: int = 12
    num_heads: int = 6
    num_tokens: int = 197
    embed_dim: int = 384


_MODELS: dict[str, Model] = {}


def register_model(name: str, model: Model) -> Model:
    """File a model under a name; empty and taken names are refused."""
    if not name or name in _MODELS:
        raise ValueError(f"model name {name!r} is empty or taken")
    _MODELS[name] = model
    return model


def models(spark: SparkSession) -> DataFrame:
    """(name, arch, patch_size, num_layers, num_heads, num_tokens, embed_dim) of all filed models."""
    rows = [(name, *asdict(model).values()) for name, model in sorted(_MODELS.items())]
    return spark.createDataFrame(rows, "name string, arch string, patch_size int, num_layers int, num_heads int, num_tokens int, embed_dim int")


class GraphProvider(Protocol):
    """A graph as three tables: nodes (graph, node, ...), edges (graph, a, b, w) and communities (graph, node, community)."""

    def nodes(self) -> DataFrame: ...

    def edges(self) -> DataFrame: ...

    def communities(self) -> DataFrame: ...


class ConceptProvider(Protocol):
    """Codes of vectors: encode gives (key, feature, activation), top the ``k`` strongest of each key."""

    def encode(self, rows: DataFrame) -> DataFrame: ...

    def top(self, rows: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class LatticeGraph:
    """The graph of published maps: lattice neighbours by likeness, communities compacted."""

    table: DataFrame

    def nodes(self) -> DataFrame:
        from .operators import lattice

        return lattice.nodes(self.table)

    def edges(self) -> DataFrame:
        from .operators import lattice

        w, n = F.col("weight"), self.nodes()
        fine = n.filter((F.size(w) == F.lit(64)) & ~F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        near = lattice.with_weights(lattice.edges(fine), fine)
        return near.select(F.col("bundle_id").alias("graph"), "a", "b", (1 / (1 + F.col("distance"))).alias("w"))

    def communities(self) -> DataFrame:
        from .operators.graph import compact

        known = self.nodes().filter("community IS NOT NULL").select(F.col("bundle_id").alias("graph"), F.col("node_id").alias("node"), "community")
        return compact(known.withColumnRenamed("community", "label"), "graph", "node", "label")


@dataclass(frozen=True)
class DictionaryConcepts:
    """Concepts by a dictionary of directions (features by dimensions) and a bias."""

    key: str
    vector: str
    weights: object
    bias: object
    width: int = field(default=32)

    def encode(self, rows: DataFrame) -> DataFrame:
        from .operators import som

        return som.sparse_codes(rows, self.key, self.vector, self.weights, self.bias, self.width)

    def top(self, rows: DataFrame, k: int) -> DataFrame:
        from .operators.positions import top_positions

        return top_positions(self.encode(rows), self.key, [F.col("activation").desc(), F.col("feature").asc()], k)


def transformed(rows: DataFrame, column: str, transform: Callable[[Column], Column]) -> DataFrame:
    """Rows with a column put through a function of columns: a built-in expression or a pandas UDF."""
    return rows.withColumn(column, transform(F.col(column)))


def labelled(features: DataFrame, hook: Callable[[Column, Column], Column] | None, fallback: Column) -> DataFrame:
    """Features with ``label``: what the hook says of (feature_id, exemplars), else the fallback."""
    said = hook(F.col("feature_id"), F.col("exemplars")) if hook is not None else F.lit(None).cast("string")
    return features.withColumn("label", F.coalesce(said, fallback))


def concept_pack(codes: DataFrame, key: str, feature: str, value: str, k: int = 8) -> DataFrame:
    """(key, feature_ids, activations): what a pack holds of each token, its ``k`` strongest features first, ties to the smaller."""
    from .operators.positions import top_positions

    top = top_positions(codes.filter(F.col(value) > 0), key, [F.col(value).desc(), F.col(feature).asc()], k, "_p")
    listed = F.array_sort(F.collect_list(F.struct("_p", feature, value)))  # k of a key
    return top.groupBy(key).agg(F.transform(listed, lambda x: x[feature]).alias("feature_ids"), F.transform(listed, lambda x: x[value]).alias("activations"))


class Analysis:
    """Uploads to results by an analyzer, a function of DataFrames that may be replaced, as tests do."""

    MOST_BYTES = 10 << 20

    def __init__(self, analyzer: Callable[[DataFrame], DataFrame]):
        self.analyzer = analyzer

    @staticmethod
    def checked(uploads: DataFrame, content: str, most: int = MOST_BYTES) -> DataFrame:
        """Adds ``status``: 413 beyond the limit, 400 for nothing, else 202, and ``job_id`` for those that are taken."""
        size = F.coalesce(F.octet_length(content), F.lit(0))
        status = F.when(size > most, 413).when(size == 0, 400).otherwise(202)
        return uploads.withColumn("status", status).withColumn("job_id", F.when(status == 202, F.substring(F.sha2(F.col(content), 256), 1, 12)))

    def run(self, uploads: DataFrame, content: str) -> DataFrame:
        return self.analyzer(self.checked(uploads, content).filter("status = 202"))


def inside(root: Column, asset: Column) -> Column:
    """The path of an asset below its root, or null where it would leave it: ``.`` and ``..`` are worked off part by part."""
    parts = F.filter(F.split(asset, "/"), lambda p: (p != "") & (p != "."))
    # a walk that ever goes above its root is refused, even if it comes back
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(False).alias("out")), lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), (s["out"] | (s["at"] + F.when(p == "..", -1).otherwise(1) < 0)).alias("out")))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    fine = ~asset.startswith("/") & ~depth["out"] & (F.size(kept) > 0)
    return F.when(fine, F.concat_ws("/", root, F.array_join(kept, "/")))

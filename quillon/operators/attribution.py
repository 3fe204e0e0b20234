"""Operators on attribution and attention tables: (image, layer, dst, src, w) and (image, token, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import with_position

#: Tokens of one image whose attention may be multiplied inside one task.
TOKENS_MOST = 1024


def masking_steps(scores: DataFrame, image: str, token: str, score: str, steps: int) -> DataFrame:
    """Adds ``step`` (from 0): tokens by falling score in ``steps`` near-equal runs, the longer runs first."""
    placed = with_position(scores.filter(F.col(image).isNotNull()), image, [F.col(score).desc(), F.col(token).asc()], "_p", "_n")
    p, short = F.col("_p") - 1, F.floor(F.col("_n") / steps)
    longer = F.col("_n") % steps
    cut = longer * (short + 1)
    step = F.when(p < cut, F.floor(p / (short + 1))).otherwise(longer + F.floor((p - cut) / F.greatest(short, F.lit(1))))
    return placed.withColumn("step", step.cast("int")).drop("_p", "_n")


def deletion_curve(scores: DataFrame, image: str, token: str, score: str, steps: int, scorer) -> DataFrame:
    """(image, step, p): ``scorer`` (a DataFrame of (image, step, masked array) to one with ``p``) after each run is masked."""
    stepped = masking_steps(scores, image, token, score, steps).groupBy(image).agg(F.collect_list(F.struct("step", token)).alias("_t"))
    grown = stepped.select(image, "_t", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    masked = F.transform(F.filter("_t", lambda t: t["step"] < F.col("step")), lambda t: t[token])
    return scorer(grown.select(image, "step", F.array_sort(masked).alias("masked"))).select(image, "step", "p")


def weighted_maps(activation: Column, weight: Column) -> Column:
    """Class activation of one place: the positive part of the weighted sum over channels, as an aggregate."""
    return F.greatest(F.sum(activation * weight), F.lit(0.0))


def path_attribution(value: Column, baseline: Column, gradient: Column) -> Column:
    """Difference from the baseline times the mean gradient along the path, as an aggregate over its steps."""
    return F.max(value - baseline) * F.avg(gradient)


def constancy(value: Column) -> Column:
    """Whether a column hardly varies: deviation over absolute mean below 1e-4, as an aggregate."""
    return F.coalesce(F.stddev_samp(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0)) < 1e-4, F.lit(False))


def rollout(attention: DataFrame) -> DataFrame:
    """(image, token, score): half attention, half identity, rows normalized, layers multiplied; the class token's row.

    One task per image, as the product is dense; more than TOKENS_MOST tokens are refused.
    """
    kind = dict(attention.dtypes)["image"]

    def multiply(rows):
        import numpy as np
        import pandas as pd

        n = int(max(rows["dst"].max(), rows["src"].max())) + 1
        if n > TOKENS_MOST:
            raise ValueError(f"{n} tokens; at most {TOKENS_MOST} are multiplied in one task")
        out = np.eye(n)
        for _, layer in rows.sort_values("layer").groupby("layer"):
            a = np.zeros((n, n))
            np.add.at(a, (layer["dst"].to_numpy(), layer["src"].to_numpy()), layer["w"].to_numpy("float64"))
            a = 0.5 * a + 0.5 * np.eye(n)
            out = (a / np.maximum(a.sum(axis=1, keepdims=True), 1e-12)) @ out
        return pd.DataFrame({"image": rows["image"].iloc[0], "token": np.arange(n), "score": out[0]})

    return attention.groupBy("image").applyInPandas(multiply, f"image {kind}, token bigint, score double")


def relevance(attention: DataFrame) -> DataFrame:
    """As ``rollout`` for (image, layer, head, dst, src, w, g): R grows by the head mean of the positive part of w * g, times R."""
    kind = dict(attention.dtypes)["image"]
    means = attention.groupBy("image", "layer", "dst", "src").agg(F.avg(F.greatest(F.col("w") * F.col("g"), F.lit(0.0))).alias("w"))

    def multiply(rows):
        import numpy as np
        import pandas as pd

        n = int(max(rows["dst"].max(), rows["src"].max())) + 1
        if n > TOKENS_MOST:
            raise ValueError(f"{n} tokens; at most {TOKENS_MOST} are multiplied in one task")
        r = np.eye(n)
        for _, layer in rows.sort_values("layer").groupby("layer"):
            a = np.zeros((n, n))
            np.add.at(a, (layer["dst"].to_numpy(), layer["src"].to_numpy()), layer["w"].to_numpy("float64"))
            r = r + a @ r
        return pd.DataFrame({"image": rows["image"].iloc[0], "token": np.arange(n), "score": r[0]})

    return means.groupBy("image").applyInPandas(multiply, f"image {kind}, token bigint, score double")


#: Fixed values of the field: the eccentricity it is bounded by, and the displacement that counts as full.
ECCENTRICITY, DISPLACEMENT = 2.5, 0.35


def token_field(tokens: DataFrame, attention: DataFrame, grid: int, most: float = ECCENTRICITY, scale: float = DISPLACEMENT) -> DataFrame:
    """Tokens (token, size, score) as a field of ellipses: their columns and x, y, rx, ry, theta, opacity, glow, halo.

    Token 0 stands for the whole image and lies at (0, 0); others lie at the centres of a grid of patches.  An ellipse is stretched
    and turned toward the mean displacement to the patches its ``attention(dst, src, w)`` goes to; opacity, glow and halo
    are size, score and the attention that a token receives, each over its largest.
    """
    place = lambda t, c: F.when(t > 0, (c + 0.5) / grid).otherwise(0.0)
    x, y = (lambda t: place(t, (t - 1) % grid)), (lambda t: place(t, F.floor((t - 1) / grid)))
    dst, src, w = F.col("dst"), F.col("src"), F.col("w")
    known = tokens.select(F.col("token").alias("src"))
    patches = attention.filter((dst > 0) & (src > 0)).join(known, "src", "left_semi")
    pull = patches.groupBy(dst.alias("token")).agg(F.sum(w * (x(src) - x(dst))).alias("vx"), F.sum(w * (y(src) - y(dst))).alias("vy"))
    got = attention.groupBy(src.alias("token")).agg(F.sum("w").alias("received"))
    t = tokens.join(pull, "token", "left").join(got, "token", "left").select(*tokens.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vx", "vy", "received")])
    top = t.agg(*[F.max(c).alias(f"_{c}") for c in ("size", "score", "received")])
    length = F.hypot("vx", "vy")
    ratio = F.sqrt(1 + (most - 1) * F.least(F.lit(1.0), length / scale))
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(1.0)))
    k, radius = F.col("token"), 0.5 / grid
    channels = {"x": x(k), "y": y(k), "rx": radius * ratio, "ry": radius / ratio, "theta": F.when(length > 1e-9, F.atan2("vy", "vx")).otherwise(0.0), "opacity": share("size"), "glow": share("score"), "halo": share("received")}
    return t.join(F.broadcast(top)).select(*tokens.columns, *[c.alias(name, metadata={"channel": i}) for i, (name, c) in enumerate(channels.items())])


def channels(field: DataFrame) -> list[str]:
    """The channels of a field in their order, which travels with the table as metadata of its columns."""
    own = [(f.metadata["channel"], f.name) for f in field.schema.fields if "channel" in f.metadata]
    return [name for _, name in sorted(own)]


def patch_colours(pixels: DataFrame, grid: int, side: int) -> DataFrame:
    """(token, r, g, b): mean colour, within [0, 1], of each patch of ``side`` pixels, and of all pixels as token 0."""
    mean = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(c))).alias(c)
    token = (1 + F.floor(F.col("y") / side) * grid + F.floor(F.col("x") / side)).cast("bigint")
    whole = pixels.agg(*[mean(c) for c in "rgb"]).select(F.lit(0).cast("bigint").alias("token"), "r", "g", "b")
    return pixels.groupBy(token.alias("token")).agg(*[mean(c) for c in "rgb"]).unionByName(whole)

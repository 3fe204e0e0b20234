"""Scalar expressions: names, buckets, geometry, interpolation, hashing, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 14


def class_from_stem(stem: Column) -> Column:
    """Without a trailing ``_<digits>``."""
    return F.regexp_replace(stem, "_[0-9]+$", "")


def pretty_attribute(name: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(name, "^has_", ""), F.lit("::"), F.lit(": ")), F.lit("_"), F.lit(" "))


def age_bucket(age: Column, edges=(20, 40, 60, 80)) -> Column:
    """Place of the half-open bucket; the last one is open. Null for what is no number."""
    years = age.try_cast("double")
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(years < edge, F.lit(i)).otherwise(out)
    return F.when(years.isNotNull(), out)


def node_id(layer: Column, token: Column) -> Column:
    return F.concat(F.lit("L"), layer.cast("string"), F.lit("_T"), token.cast("string"))


def parse_node_id(text: Column) -> Column:
    """struct<layer int, token int>, null where the text is no node id."""
    good = text.rlike(r"^L[0-9]+_T[0-9]+$")
    part = lambda i: F.regexp_extract(text, r"^L([0-9]+)_T([0-9]+)$", i).cast("int")
    return F.when(good, F.struct(part(1).alias("layer"), part(2).alias("token")))


def token_row(token: Column) -> Column:
    """Row of a patch token (token 0 is the class token: null)."""
    return F.when(token > 0, F.floor((token - 1) / GRID).cast("int"))


def token_col(token: Column) -> Column:
    return F.when(token > 0, ((token - 1) % GRID).cast("int"))


def patch_centre(token: Column) -> Column:
    """struct<x, y> in the unit square; the class token sits at the origin."""
    x = F.when(token > 0, (token_col(token) + 0.5) / GRID).otherwise(0.0)
    y = F.when(token > 0, (token_row(token) + 0.5) / GRID).otherwise(0.0)
    return F.struct(x.alias("x"), y.alias("y"))


def unit_hash(key: Column, seed: Column) -> Column:
    """(md5(key-seed) mod 10^6) / 10^6, from four words of 32 bits."""
    digest = F.md5(F.concat_ws("-", key.cast("string"), seed.cast("string")))
    m, rest = F.lit(1_000_000), F.lit(0).cast("bigint")
    for i in range(4):
        word = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit(1 << 32) + word) % m
    return rest / 1_000_000.0


def bracket(t: Column, steps: Column) -> Column:
    """struct<lo, hi, frac> of the steps around ``t``, clamped to [0, steps - 1]."""
    at = F.greatest(F.lit(0.0), F.least(t.cast("double"), (steps - 1).cast("double")))
    lo = F.floor(at).cast("int")
    return F.struct(lo.alias("lo"), F.least(lo + 1, steps - 1).cast("int").alias("hi"), (at - lo).alias("frac"))


def lerp_angle(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter way round."""
    return a + F.atan2(F.sin(b - a), F.cos(b - a)) * t


def ease_in_out(t: Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x * x * (3 - 2 * x)


def lattice_world(i: Column, size: Column, extent: float = 0.9) -> Column:
    """Centred coordinate of a lattice index; 0 on an axis of one."""
    return F.when(size > 1, i / (size - 1) * 2 * extent - extent).otherwise(F.lit(0.0))


def size_for_hits(hits: Column, most: Column, low: float = 0.16, high: float = 1.0) -> Column:
    return F.when((hits > 0) & (most > 0), low + (high - low) * F.sqrt(hits / most)).otherwise(F.lit(low))


def formatted(x: Column, digits: int = 4) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", x))


def rounded_or_zero(a: Column, digits: int = 3, least: float = 0.005) -> Column:
    """Array with small values pruned to 0 and the others rounded."""
    return F.transform(a, lambda x: F.when(F.abs(x) < least, F.lit(0.0)).otherwise(F.round(x.cast("double"), digits)))


def ref_key(kind: Column, *parts: Column) -> Column:
    return F.concat_ws(":", kind, *[p.cast("string") for p in parts])


def content_type(path: Column) -> Column:
    kinds = {"json": "application/json", "png": "image/png", "webp": "image/webp", "bin": "application/octet-stream"}
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit("application/octet-stream")
    for name, kind in kinds.items():
        out = F.when(suffix == name, F.lit(kind)).otherwise(out)
    return out


def region_words(row: Column, col: Column) -> Column:
    """Words for a mean place in the unit square, by thirds: rows run down, columns across."""
    down = F.when(row < 0.34, "upper").when(row > 0.66, "lower")
    across = F.when(col < 0.34, "left").when(col > 0.66, "right")
    where = F.concat_ws("-", down, across)
    return F.when(row.isNull() | col.isNull(), "attention hub").when(where == "", "central patches").otherwise(F.concat(where, F.lit(" patches")))

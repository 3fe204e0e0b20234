"""Expressions over ``array<float>`` and ``array<double>`` columns, all inside the JVM and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def argmax(a: Column) -> Column:
    """0-based place of the first largest value; null for null or empty arrays."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    top = F.array_max(a).cast("double")
    raised = F.transform(a, lambda x: F.exp(x.cast("double") - top))
    return F.transform(raised, lambda x: x / total(raised))


def top_k(a: Column, k: int) -> Column:
    """The ``k`` largest as array<struct<v, i>>, stable: equal values by place."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct((-s["v"]).alias("v"), s["i"].alias("i")))


def peak_normalized(a: Column) -> Column:
    """Divided by the largest value; as it is where that is not above zero."""
    top = F.array_max(a)
    return F.when(top > 0, F.transform(a, lambda x: x / top)).otherwise(a)


def unit_range(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaled into [0, 1]; 0 where the range is flat."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))).otherwise(F.lit(0.0))


def quantized(a: Column) -> Column:
    """struct<q array<int>, scale double>: values as 0..255 of the row's maximum, which is 1 if not positive."""
    top = F.when(F.array_max(a) > 0, F.array_max(a).cast("double")).otherwise(F.lit(1.0))
    q = F.transform(a, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x.cast("double") / top * 255).cast("int"))))
    return F.struct(q.alias("q"), top.alias("scale"))


def dequantized(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 255 * scale)


def half_to_float(bits: Column) -> Column:
    """IEEE half precision in the low 16 bits of an integer."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, part = F.shiftright(bits, 10).bitwiseAND(0x1F), bits.bitwiseAND(0x3FF)
    tiny = F.pow(F.lit(2.0), F.lit(-24)) * part
    ordinary = F.pow(F.lit(2.0), exponent - 15) * (1 + part / F.lit(1024.0))
    special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0, tiny).when(exponent == 31, special).otherwise(ordinary)


def trapezoid(a: Column) -> Column:
    """Area under values evenly spaced over [0, 1]; the value itself for one, 0 for none."""
    n = F.size(a)
    inner = (total(a) - (F.element_at(a, 1).cast("double") + F.element_at(a, -1).cast("double")) / 2) / (n - 1)
    return F.when(n >= 2, inner).when(n == 1, F.element_at(a, 1).cast("double")).otherwise(F.lit(0.0))


def weighted_sum(terms: Column, weights: dict[str, float]) -> Column:
    """Sum over a map of named terms of weight times term; a term without a weight, or without a value, counts nothing."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.coalesce(F.try_element_at(terms, F.lit(name)).cast("double"), F.lit(0.0))
    return total


def at_step(rows, column: str, step: int):
    """The rows of one step of a trace; a step that is not there is an error that names those that are."""
    found = rows.filter(F.col(column) == step)
    if found.isEmpty():
        ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
        raise ValueError(f"{column}: no step {step}; steps go from {ends.a} to {ends.b}")
    return found

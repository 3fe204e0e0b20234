"""Aggregates over activations: firing rates, coherence, affinity, co-activation, attribute grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .positions import checkpointed, join_hot


def firing_rates(rows: DataFrame, feature: str, label: str, activation: str, threshold: float = 0.0) -> DataFrame:
    """(feature, label, rate): share of rows above ``threshold``, 0 where a feature never meets a class.

    Labels below zero are unknown. The grid is features by classes; classes are few.
    """
    known = rows.filter(F.col(label) >= 0)
    if len(known.select(label).distinct().take(CLASSES_MOST + 1)) > CLASSES_MOST:
        raise ValueError(f"more than {CLASSES_MOST} classes; each is a column of the grid and sent to every task")
    rates = known.groupBy(feature, label).agg(F.avg((F.col(activation) > threshold).cast("int")).alias("rate"))
    classes = known.select(label).distinct().agg(F.collect_set(label).alias("_classes"))
    grid = rows.select(feature).distinct().join(F.broadcast(classes)).select(feature, F.explode("_classes").alias(label))
    return grid.join(rates, [feature, label], "left").select(feature, label, F.coalesce("rate", F.lit(0.0)).alias("rate"))


def coherence(rows: DataFrame, feature: str, label: str) -> DataFrame:
    """(feature, coherence): share of the most frequent class among a feature's exemplars."""
    counted = rows.groupBy(feature, label).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(feature).agg((F.max("n") / F.sum("n")).alias("coherence"))


def quality_gate(features: DataFrame, dead: float | None = 0.0, most_dead: float = 0.5, least_coherence: float = 0.3, most_duplicates: float = 0.35) -> DataFrame:
    """One row: live features, mean coherence, duplicate rate, verdict and the reasons against.

    ``dead`` is the dead rate that training reported; None takes it from the dictionary, as the share of features without
    an exemplar, and adds ``dead_rate``.
    """
    live = features.filter(F.size("exemplars") > 0).select(F.coalesce("coherence", F.lit(0.0)).alias("c"), F.element_at("exemplars", 1).alias("e"))
    # a null place is a place too, so it is written out before the distinct count
    place = F.concat_ws("\x1f", F.coalesce("e.image_id", F.lit("\x00")), F.coalesce(F.col("e.token_idx").cast("string"), F.lit("\x00")))
    one = live.agg(F.count(F.lit(1)).alias("live"), F.avg("c").alias("coherence"), F.countDistinct(place).alias("places"))
    one = one.select("live", F.coalesce("coherence", F.lit(0.0)).alias("coherence"), F.when(F.col("live") > 0, 1 - F.col("places") / F.col("live")).otherwise(1.0).alias("duplicate_rate"))
    rate = F.lit(dead)
    if dead is None:
        share = F.count(F.when(F.coalesce(F.size("exemplars"), F.lit(0)) <= 0, 1)) / F.nullif(F.count(F.lit(1)), F.lit(0))
        one, rate = one.join(F.broadcast(features.agg(share.alias("dead_rate")))), F.col("dead_rate")
    reasons = F.array_compact(
        F.array(
            F.when(rate > most_dead, F.lit("dead_feature_rate")),
            F.when(F.col("coherence") < least_coherence, F.lit("exemplar_coherence")),
            F.when(F.col("duplicate_rate") > most_duplicates, F.lit("duplicate_feature_rate")),
        )
    )
    return one.withColumn("reasons", reasons).withColumn("use_sae", F.size("reasons") == 0)


def normalized(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the value over the length of its key's vector (+1e-8)."""
    length = rows.groupBy(key).agg((F.sqrt(F.sum(F.col(value) * F.col(value))) + 1e-8).alias("_length"))
    return rows.join(length, key).withColumn(name, F.col(value) / F.col("_length")).drop("_length")


def class_affinity(rows: DataFrame, key: str, unit: str, label: str, value: str) -> DataFrame:
    """(unit, label, affinity): mean over the label's keys, an absent unit counting as 0."""
    size = rows.groupBy(label).agg(F.countDistinct(key).alias("_n"))
    return rows.groupBy(unit, label).agg(F.sum(value).alias("_s")).join(size, label).select(unit, label, (F.col("_s") / F.greatest(F.col("_n"), F.lit(1))).alias("affinity"))


#: Units of one key that meet in one task, at most about this many squared; keys of more are cut by a hash of the unit.
KEY_BLOCK = 512
CLASSES_MOST = 100_000
#: Units whose roots are sent to every task, at most; those of more are joined by shuffle.
UNITS_SENT = 1_000_000


def _key_sizes(rows: DataFrame, key: str):
    """(key, _n) of each key, and one row: the most units of a key, all rows, all keys."""
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return size, size.agg(F.max("_n").alias("most"), F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys")).first()


def pairs_in_keys(rows: DataFrame, key: str, unit: str, value: str, block: int | None = None, sizes=None) -> DataFrame:
    """(key, i, j, x, y), i <= j: all pairs of units of each key.  A key of many units is met block by block, in many tasks."""
    block = block or KEY_BLOCK
    size, most = sizes or _key_sizes(rows, key)
    if (most.most or 0) <= block:
        left, right = rows.select(key, F.col(unit).alias("i"), F.col(value).alias("x")), rows.select(key, F.col(unit).alias("j"), F.col(value).alias("y"))
        return left.join(right, key).filter("i <= j")
    size = size.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    cut = join_hot(rows.select(key, unit, value), size, [key], rows=most.rows).withColumn("_own", F.pmod(F.xxhash64(unit), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    x = cut.select(key, F.col(unit).alias("i"), F.col(value).alias("x"), F.col("_own").alias("_a"), F.col("_other").alias("_b"))
    y = cut.select(key, F.col(unit).alias("j"), F.col(value).alias("y"), F.col("_own").alias("_b"), F.col("_other").alias("_a"))
    return x.join(y, [key, "_a", "_b"]).filter("i <= j").select(key, "i", "j", "x", "y")


def coactivation(rows: DataFrame, key: str, unit: str, value: str, block: int | None = None) -> DataFrame:
    """(i, j, c), i <= j: mean over the keys of the product of two units."""
    rows = rows.filter(F.col(key).isNotNull())
    n = rows.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    sums = pairs_in_keys(rows, key, unit, value, block).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return sums.join(F.broadcast(n)).select("i", "j", (F.col("s") / F.col("_n")).alias("c"))


def correlation(pairs: DataFrame) -> DataFrame:
    """(i, j, r): co-activation over the roots of the two diagonal entries."""
    diagonal = pairs.filter("i = j").select("i", F.sqrt(F.greatest(F.col("c"), F.lit(1e-12))).alias("root"))
    left, right = diagonal.withColumnRenamed("root", "ri"), diagonal.select(F.col("i").alias("j"), F.col("root").alias("rj"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", (F.col("c") / F.col("ri") / F.col("rj")).alias("r"))


def correlated(rows: DataFrame, key: str, unit: str, value: str, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(i, j, r), i <= j, as ``correlation`` of ``coactivation``, and (unit, mean) of all rows, for many pairs of units.

    Pairs are made and shuffled once, and the diagonal, a row a unit, comes from the rows themselves.
    """
    known = rows.filter(F.col(key).isNotNull() & F.col(unit).isNotNull())
    own = F.sum(F.when(F.col(key).isNotNull(), F.col(value) * F.col(value)))
    units = checkpointed(rows.groupBy(F.col(unit).alias("unit")).agg(F.avg(value).alias("mean"), own.alias("s")))
    sizes = _key_sizes(known, key)
    n = F.lit(float(max(sizes[1]["keys"], 1)))
    sums = pairs_in_keys(known, key, unit, value, block, sizes).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    roots = units.filter("unit IS NOT NULL AND s IS NOT NULL").select("unit", F.sqrt(F.greatest(F.col("s") / n, F.lit(1e-12))).alias("root"))
    left, right = roots.select(F.col("unit").alias("i"), F.col("root").alias("ri")), roots.select(F.col("unit").alias("j"), F.col("root").alias("rj"))
    if roots.count() <= UNITS_SENT:
        left, right = F.broadcast(left), F.broadcast(right)
    pairs = sums.join(left, "i").join(right, "j").select("i", "j", (F.col("s") / n / F.col("ri") / F.col("rj")).alias("r"))
    return pairs, units.select("unit", "mean")


def effect_size(rows: DataFrame, attribute: str, positive: Column, value: str, least: int = 5) -> DataFrame:
    """(attribute, effect): difference of the means with and without, over the sample deviation + 1e-8."""
    one = rows.groupBy(attribute).agg(
        F.avg(F.when(positive, F.col(value))).alias("_p"),
        F.avg(F.when(~positive, F.col(value))).alias("_q"),
        F.count(F.when(positive, 1)).alias("_np"),
        F.count(F.when(~positive, 1)).alias("_nq"),
        F.stddev_samp(value).alias("_s"),
    )
    return one.filter((F.col("_np") >= least) & (F.col("_nq") >= least)).select(attribute, ((F.col("_p") - F.col("_q")) / (F.col("_s") + 1e-8)).alias("effect"))


def attribute_lift(weights: DataFrame, profile: DataFrame, concept: str) -> DataFrame:
    """(concept, attr, lift) > 0: the profile weighted by a concept's classes, less the attribute's mean."""
    mean = profile.groupBy("attr").agg(F.avg("v").alias("mean"))
    scored = weights.join(profile, "cls").groupBy(concept, "attr").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("x"))
    return scored.join(mean, "attr").select(concept, "attr", (F.col("x") - F.col("mean")).alias("lift")).filter("lift > 0")


def flagged_mass(p: Column, flagged: tuple[int, ...]) -> Column:
    """Sum of the flagged probabilities within [0, 1]; a missing one counts as 0."""
    mass = F.lit(0.0)
    for i in flagged:
        mass = mass + F.coalesce(F.get(p, F.lit(i)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass))


def expected_level(p: Column, levels: tuple[int, ...]) -> Column:
    """Probability-weighted mean level; 0 where there is no mass."""
    weighted = V.dot(p, F.array(*[F.lit(float(x)) for x in levels]))
    return F.when(V.total(p) > 0, weighted / V.total(p)).otherwise(F.lit(0.0))


def probe_activations(fires: DataFrame, image: str, unit: str, value: str) -> DataFrame:
    """(image, unit, activation): repeated fires of a unit in one image are averaged, never put side by side."""
    return fires.filter(F.col(image).isNotNull() & F.col(unit).isNotNull() & F.col(value).isNotNull()).groupBy(image, unit).agg(F.avg(value).alias("activation"))


def tracked_units(state: DataFrame, unit: str, index: DataFrame) -> DataFrame:
    """The rows of a loaded state with the original channel of each subsampled unit, by ``index(place, channel)``."""
    return state.join(index.select(F.col("place").alias(unit), "channel"), unit)


def sparse_diagnostics(codes: DataFrame, key: str, feature: str, value: str, inputs: DataFrame, decoder: DataFrame, dimensions: int, close: float = 0.9) -> DataFrame:
    """One row about sparse codes (key, feature, value): features, dead rate, L0, reconstruction loss, duplicate rate.

    ``inputs(key, x)`` are the vectors that were coded, ``decoder(feature, d)`` the decoder's direction of every feature.
    L0 is the mean number of active features of a row, those of none among them; the loss is the mean squared error over
    rows and dimensions; a feature is a duplicate if the cosine of its direction with another's is above ``close``.
    Pairs of directions are compared block by block, as the matrix product of ``dense.cosine_neighbours``.
    """
    from .dense import cosine_neighbours

    features = decoder.agg(F.count(F.lit(1)).alias("n_features"))
    active = codes.filter(F.col(value) != 0)
    dead = decoder.join(active.select(feature).distinct(), feature, "left_anti").agg(F.count(F.lit(1)).alias("_dead"))
    parts = active.join(decoder, feature).groupBy(key).agg(F.count(F.lit(1)).alias("_l0"), *[F.sum(F.col(value) * F.get("d", F.lit(i))).alias(f"_r{i}") for i in range(dimensions)])
    error = lambda i: F.pow(F.get("x", F.lit(i)).cast("double") - F.coalesce(f"_r{i}", F.lit(0.0)), 2)
    rebuilt = inputs.join(parts, key, "left").agg(F.avg(F.coalesce("_l0", F.lit(0))).alias("l0"), (F.avg(sum(error(i) for i in range(dimensions))) / dimensions).alias("recon_loss"))
    twins = cosine_neighbours(decoder, decoder, feature, "d", 1).filter(F.col("s") > close).agg(F.count(F.lit(1)).alias("_twins"))
    one = features.join(F.broadcast(dead)).join(F.broadcast(rebuilt)).join(F.broadcast(twins))
    return one.select("n_features", (F.col("_dead") / F.col("n_features")).alias("dead_rate"), "l0", "recon_loss", (F.col("_twins") / F.col("n_features")).alias("duplicate_rate"))


def concept_clusters(correlations: DataFrame, activity: DataFrame, concepts: int = 8, least_units: int = 2, share: float = 0.02) -> DataFrame:
    """(unit, concept): units of like correlation rows (i, j, r; i <= j), by Ward's agglomeration.

    Units whose mean activity is at most ``share`` of the most active one's are left out first; if fewer than
    ``max(2 * least_units, 4)`` are left, all are kept.  Merging goes on until ``concepts`` are left, or as many as have
    ``least_units`` units each on average; concepts of fewer units than that are not reported, and concepts are numbered
    by their smallest unit.  Any number of units is clustered, see ``ward``; the work is quadratic in it.
    """
    import numpy as np
    import pandas as pd

    from .ward import ward

    fired = activity.agg(F.max("mean").alias("_top"))
    chosen = activity.join(F.broadcast(fired)).filter(F.col("mean") > share * F.greatest("_top", F.lit(1e-12)))
    sorted_units = lambda rows: np.sort(rows.select(F.col("unit").cast("bigint")).dropna().distinct().toArrow().column(0).to_numpy())
    units = sorted_units(chosen)
    if len(units) < max(2 * least_units, 4):
        units = sorted_units(activity)
    n = len(units)
    head = ward(correlations, units, max(1, min(concepts, n // least_units, n))) if n else np.zeros(0, "int64")
    first, own, size = np.unique(head, return_inverse=True, return_counts=True)
    kept = size >= least_units
    found = pd.DataFrame({"unit": units, "concept": (np.cumsum(kept) - 1)[own]})[kept[own]]
    return activity.sparkSession.createDataFrame(found, "unit bigint, concept bigint")

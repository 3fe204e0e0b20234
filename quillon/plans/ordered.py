"""Ordered and running operators."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ordered as O
from ..operators.cumulative import exact_percentiles
from ..operators.positions import with_position
from ..session import load
from .registry import query

_PACKS = "packs AS (SELECT DISTINCT ON (pack_id) pack_id, run_id, prediction.confidence AS c, faithfulness.deletion_auc.chefer AS a, faithfulness.deletion_auc.rollout AS b FROM pack_manifest)"


def packs(spark, d):
    rows = load(spark, d, "pack_manifest").select("pack_id", "run_id", F.col("prediction.confidence").alias("c"), F.col("faithfulness.deletion_auc.chefer").alias("a"), F.col("faithfulness.deletion_auc.rollout").alias("b"))
    return rows.dropDuplicates(["pack_id"])


def finite(name):
    return ~F.isnan(name) & (F.abs(name) < float("inf"))


@query(f"""WITH {_PACKS} SELECT pack_id, run_id, rank() OVER (PARTITION BY run_id ORDER BY c) + (count(*) OVER (PARTITION BY run_id, c) - 1) / 2.0 - 1 AS r FROM packs WHERE isfinite(c)""")
def average_ranks(spark, d):
    return O.average_rank(packs(spark, d).filter(finite("c")), ["run_id"], "c", "r").select("pack_id", "run_id", "r")


_RANKS = f"""WITH {_PACKS}, ok AS (SELECT * FROM packs WHERE isfinite(a) AND isfinite(b)), r AS (SELECT run_id,
 rank() OVER (PARTITION BY run_id ORDER BY a) + (count(*) OVER (PARTITION BY run_id, a) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY run_id ORDER BY b) + (count(*) OVER (PARTITION BY run_id, b) - 1) / 2.0 AS rb FROM ok),
 s AS (SELECT run_id, count(*) AS n, avg(ra) AS ma, avg(rb) AS mb, sum(ra * rb) AS sab, sum(ra * ra) AS saa, sum(rb * rb) AS sbb FROM r GROUP BY run_id)"""


@query(_RANKS + """ SELECT run_id, round(CASE WHEN saa - n * ma * ma <= 1e-9 OR sbb - n * mb * mb <= 1e-9 THEN 0 ELSE (sab - n * ma * mb) / sqrt((saa - n * ma * ma) * (sbb - n * mb * mb)) END, 9) AS rho FROM s""")
def method_agreement(spark, d):
    """Spearman correlation of two attribution methods by run."""
    return O.spearman(packs(spark, d).filter(finite("a") & finite("b")), ["run_id"], "a", "b").select("run_id", F.round("rho", 9).alias("rho"))


_TIMES = "t AS (SELECT DISTINCT ON (event_id) event_id, user_id, ts, event_type, value FROM events)"


def events(spark, d):
    return load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value").dropDuplicates(["event_id"])


@query(f"""WITH {_TIMES}, p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM t)
SELECT step, round(avg((event_type <> before)::INT), 9) AS rate FROM p WHERE before IS NOT NULL GROUP BY step""")
def migration_curve(spark, d):
    """Share of cells that change between consecutive steps."""
    e = with_position(events(spark, d).filter("user_id IS NOT NULL"), "user_id", [F.col("ts").asc(), F.col("event_id").asc()], "step")
    return O.migration(e, ["user_id"], "step", "event_type").select("step", F.round("rate", 9).alias("rate"))


@query(f"""WITH {_TIMES}, p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM t)
SELECT user_id, round(sum(0.2 * power(0.8, back) * value), 9) AS ema FROM p GROUP BY user_id""")
def last_ema(spark, d):
    """Exponential average of each timeline after its last value, from zero."""
    e = with_position(events(spark, d).filter("user_id IS NOT NULL"), "user_id", [F.col("ts").asc(), F.col("event_id").asc()], "place", "total")
    return O.last_ema(e, "user_id", "value", "place", "total", 0.2).select("user_id", F.round("ema", 9).alias("ema"))


@query(f"""WITH {_TIMES}, e AS (SELECT user_id, max(ts) AS last FROM t GROUP BY user_id), p AS (SELECT t.user_id, value, epoch(last) - epoch(ts) AS back,
 epoch(ts) - epoch(lag(ts) OVER (PARTITION BY t.user_id ORDER BY ts, event_id)) AS dt FROM t JOIN e USING (user_id))
SELECT user_id, round(sum((CASE WHEN dt IS NULL THEN 1 ELSE 1 - exp(-dt / 86400.0) END) * exp(-back / 86400.0) * value), 9) AS ema FROM p GROUP BY user_id""")
def time_aware_ema(spark, d):
    """Exponential average that weighs by elapsed time: 1 - exp(-dt / tau) at each step, the first value taken whole."""
    e = events(spark, d).filter("user_id IS NOT NULL").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    last = e.groupBy("user_id").agg(F.max("s").alias("last"))
    e = with_position(e, "user_id", [F.col("ts").asc(), F.col("event_id").asc()], "step")
    dt = F.col("s") - F.col("_previous")
    alpha = F.when(dt.isNull(), F.lit(1.0)).otherwise(1 - F.exp(-dt / 86400.0))
    placed = O.with_previous(e, ["user_id"], "step", "s").withColumn("alpha", alpha).join(last, "user_id")
    return placed.groupBy("user_id").agg(F.round(F.sum(F.col("alpha") * F.exp(-(F.col("last") - F.col("s")) / 86400.0) * F.col("value")), 9).alias("ema"))


@query(f"""WITH {_TIMES}, m AS (SELECT median(value) AS m FROM t), s AS (SELECT event_id, user_id, ts, CASE WHEN value > m + 0.06 THEN true WHEN value <= m - 0.06 THEN false END AS d FROM t, m)
SELECT event_id, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS visible FROM s""")
def label_hysteresis(spark, d):
    """Visibility with a margin around the median value."""
    e = events(spark, d)
    middle = exact_percentiles(e, [], "value", (0.5,)).select(F.col("p50").alias("middle"))
    return O.hysteresis(e.join(F.broadcast(middle)), "user_id", ["ts", "event_id"], "value", F.col("middle")).select("event_id", "visible")


_N = "nodes AS (SELECT DISTINCT ON (node_id) node_id, bundle_id, idx, grid.z AS z, hits, umatrix, community, dead FROM sgp_node)"


def nodes(spark, d):
    return load(spark, d, "sgp_node").select("node_id", "bundle_id", "idx", F.col("grid.z").alias("z"), "hits", "umatrix", "community", "dead").dropDuplicates(["node_id"])


@query("""SELECT bundle_id, grid.y AS y, grid.x AS x, string_agg(idx, '>' ORDER BY grid.z, node_id) AS trail FROM (SELECT DISTINCT ON (node_id) * FROM sgp_node) WHERE grid.z IS NOT NULL GROUP BY ALL""")
def trail(spark, d):
    """Ordered units of each cell over the depths of its map, at most one for each depth."""
    n = load(spark, d, "sgp_node").select("node_id", "bundle_id", "idx", "grid").dropDuplicates(["node_id"]).filter("grid.z IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("grid.z", "node_id", "idx")))
    return n.groupBy("bundle_id", F.col("grid.y").alias("y"), F.col("grid.x").alias("x")).agg(F.array_join(F.transform(ordered, lambda s: s["idx"].cast("string")), ">").alias("trail"))


@query(f"WITH {_N} SELECT bundle_id, z, idx, round(CASE WHEN sum(hits) OVER (PARTITION BY bundle_id, z) > 0 THEN hits / sum(hits) OVER (PARTITION BY bundle_id, z) ELSE 0 END, 9) AS share FROM nodes")
def depth_histogram(spark, d):
    """Share of each node in the hits of its depth."""
    n = nodes(spark, d)
    total = n.groupBy("bundle_id", "z").agg(F.sum("hits").alias("all"))
    return n.join(total, ["bundle_id", "z"]).select("bundle_id", "z", "idx", F.round(F.when(F.col("all") > 0, F.col("hits") / F.col("all")).otherwise(0.0), 9).alias("share"))


@query(f"""WITH {_N}, h AS (SELECT bundle_id, z, avg(hits) AS v FROM nodes GROUP BY ALL)
SELECT a.bundle_id, a.z, round(a.v * (1 - 0.25) + coalesce(b.v, a.v) * 0.25, 9) AS v FROM h a LEFT JOIN h b ON a.bundle_id = b.bundle_id AND b.z = a.z + 1""")
def depth_interpolated(spark, d):
    """Mean hits a quarter of a step beyond each depth; the last depth stays."""
    h = nodes(spark, d).groupBy("bundle_id", "z").agg(F.avg("hits").alias("v"))
    after = h.select("bundle_id", (F.col("z") - 1).alias("z"), F.col("v").alias("w"))
    return h.join(after, ["bundle_id", "z"], "left").select("bundle_id", "z", F.round(F.col("v") * 0.75 + F.coalesce("w", "v") * 0.25, 9).alias("v"))


@query(f"""WITH {_N}, f AS (SELECT bundle_id, community, min(idx) AS first FROM nodes WHERE community IS NOT NULL GROUP BY ALL)
SELECT bundle_id, community, row_number() OVER (PARTITION BY bundle_id ORDER BY first) - 1 AS canonical FROM f""")
def canonical_labels(spark, d):
    """Communities renumbered by first occurrence in each bundle."""
    return O.first_seen_labels(nodes(spark, d), ["bundle_id"], "community", "idx").select("bundle_id", "community", "canonical")


@query(f"""WITH {_N}, b AS (SELECT bundle_id, min(umatrix) AS lo, max(umatrix) AS hi FROM nodes GROUP BY ALL)
SELECT node_id, round(CASE WHEN hi > lo THEN (umatrix - lo) / (hi - lo) ELSE 0 END, 9) AS strength FROM nodes JOIN b USING (bundle_id) WHERE umatrix IS NOT NULL""")
def boundary_strength(spark, d):
    n = nodes(spark, d)
    bounds = n.groupBy("bundle_id").agg(F.min("umatrix").alias("lo"), F.max("umatrix").alias("hi"))
    return n.filter("umatrix IS NOT NULL").join(bounds, "bundle_id").select("node_id", F.round(V.unit_range(F.col("umatrix"), F.col("lo"), F.col("hi")), 9).alias("strength"))


@query(f"""WITH {_N}, h AS (SELECT bundle_id, z, avg(umatrix) AS v FROM nodes WHERE isfinite(umatrix) GROUP BY ALL), s AS (SELECT bundle_id, v - lag(v) OVER (PARTITION BY bundle_id ORDER BY z) AS d FROM h)
SELECT bundle_id, count(d) AS steps, CASE WHEN count(d) < 1 THEN 'undetermined' WHEN bool_and(d <= 1e-4) THEN 'monotone' ELSE 'not monotone' END AS verdict FROM s GROUP BY bundle_id""")
def monotone_verdict(spark, d):
    h = nodes(spark, d).filter(finite("umatrix")).groupBy("bundle_id", "z").agg(F.avg("umatrix").alias("v"))
    return O.not_rising(h, "bundle_id", "z", "v")


@query("""SELECT feature_id, round((list_sum(firing_rates)::DOUBLE - (firing_rates[1]::DOUBLE + firing_rates[-1]::DOUBLE) / 2) / (len(firing_rates) - 1), 9) AS area FROM concept_feature WHERE len(firing_rates) >= 2""")
def curve_area(spark, d):
    """Trapezoid area under an evenly spaced curve."""
    return load(spark, d, "concept_feature").filter(F.size("firing_rates") >= 2).select("feature_id", F.round(V.trapezoid(F.col("firing_rates")), 9).alias("area"))


@query(f"""WITH {_PACKS}, v AS (SELECT pack_id, CASE WHEN isfinite(c) THEN greatest(0, least(12, c * 12)) END AS t FROM packs)
SELECT pack_id, CASE WHEN t < 2 THEN 0 WHEN t < 5 THEN 1 WHEN t < 9 THEN 2 ELSE 3 END AS stage,
 round(1.25 * (0.35 + 0.65 * sin(pi() * CASE WHEN t < 2 THEN t / 2 WHEN t < 5 THEN (t - 2) / 3 WHEN t < 9 THEN (t - 5) / 4 ELSE (t - 9) / 3 END)), 9) AS velocity FROM v WHERE t IS NOT NULL""")
def stage_velocity(spark, d):
    """Stage of a position on a timeline and the half-sine rate within it."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(12.0), F.col("c") * 12))
    v = packs(spark, d).filter(finite("c")).select("pack_id", t.alias("t"))
    stage = F.when(F.col("t") < 2, 0).when(F.col("t") < 5, 1).when(F.col("t") < 9, 2).otherwise(3)
    inside = F.when(F.col("t") < 2, F.col("t") / 2).when(F.col("t") < 5, (F.col("t") - 2) / 3).when(F.col("t") < 9, (F.col("t") - 5) / 4).otherwise((F.col("t") - 9) / 3)
    return v.select("pack_id", stage.alias("stage"), F.round(1.25 * (0.35 + 0.65 * F.sin(F.lit(3.141592653589793) * inside)), 9).alias("velocity"))

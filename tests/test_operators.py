import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions import vectors as V
from quillon.operators import axis, concepts, dense, graph, lattice, ordered, positions, splitting


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_positions_of_a_group_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.col("id").alias("v"))
    placed = positions.with_position(df, "g", [F.col("v").desc()], "p", "n").collect()
    by = {}
    for r in placed:
        by.setdefault(r.g, []).append((r.p, r.v, r.n))
    assert sum(map(len, by.values())) == 5000
    for group in by.values():
        group.sort()
        assert [p for p, _, _ in group] == list(range(1, len(group) + 1))
        assert [v for _, v, _ in group] == sorted((v for _, v, _ in group), reverse=True)
        assert {n for _, _, n in group} == {len(group)}


def test_top_positions_equal_a_window(spark):
    df = spark.range(0, 3000, 1, 6).select((F.col("id") % 7 % 3).alias("g"), (F.col("id") % 40).alias("s"), "id")
    top = positions.top_positions(df, "g", [F.col("s").desc(), F.col("id").asc()], 11)
    from pyspark.sql import Window

    window = Window.partitionBy("g").orderBy(F.col("s").desc(), "id")
    assert rows(top.select("g", "id", "position")) == rows(df.withColumn("position", F.row_number().over(window)).filter("position <= 11").select("g", "id", F.col("position").cast("bigint")))


def test_positions_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, v bigint")
    assert positions.with_position(empty, "g", [F.col("v").asc()]).count() == 0
    assert positions.top_positions(empty, "g", [F.col("v").asc()], 3).count() == 0


def test_splits_keep_groups_and_proportions(spark):
    df = spark.range(2000).select("id", (F.col("id") % 173).alias("grp"), (F.col("id") % 4).cast("string").alias("cls"))
    split = splitting.stratified(df, "id", "cls", 0.7, 0.15, 3)
    counts = {(r.cls, r.split): r["count"] for r in split.groupBy("cls", "split").count().collect()}
    assert all(counts[c, "train"] == 350 and counts[c, "val"] == 75 and counts[c, "test"] == 75 for c in "0123")
    whole = splitting.grouped_stratified(df, "grp", "cls", "id", 0.7, 0.15)
    assert whole.count() == 2000 and splitting.leaking_groups(whole, "grp").count() == 0
    assert rows(splitting.stratified(df.orderBy(F.rand(1)), "id", "cls", 0.7, 0.15, 3)) == rows(split)
    single = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id bigint, cls string")
    assert {r.cls: r.n for r in splitting.at_least_one(single, "id", "cls", 0.01).groupBy("cls").agg(F.count(F.when(F.col("split") == "val", 1)).alias("n")).collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        splitting.check_fractions(0.5, 0.6, 0.1)


def test_half_even_rounding(spark):
    df = spark.range(5).select("id", F.lit("s").alias("s"))
    assert splitting.stratified(df, "id", "s", 0.5, 0.0).filter("split = 'train'").count() == 2  # 2.5 to even


def test_unit_hash_equals_md5(spark):
    import hashlib

    for key in ("a", "group 7", ""):
        want = int(hashlib.md5(f"{key}-42".encode()).hexdigest(), 16) % 1_000_000 / 1_000_000
        assert one(spark, S.unit_hash(F.lit(key), F.lit("42"))) == pytest.approx(want)


@pytest.mark.parametrize("bits", [0, 1, 0x3C00, 0xC000, 0x7BFF, 0x0400, 0x03FF, 0x7C00, 0xFC00])
def test_half_decode(spark, bits):
    import numpy as np

    assert one(spark, V.half_to_float(F.lit(bits))) == float(np.array([bits], "uint16").view("float16")[0])


def test_quantize_round_trip_is_bounded(spark):
    z = V.quantized(F.array(*[F.lit(x) for x in (0.1, 0.5, 2.0, 0.0)]))
    r = spark.range(1).select(z.alias("z")).select(V.dequantized(F.col("z.q"), F.col("z.scale")).alias("x")).first()
    assert all(abs(a - b) <= 0.5 / 255 * 2.0 + 1e-12 for a, b in zip(r.x, (0.1, 0.5, 2.0, 0.0)))
    assert one(spark, V.quantized(F.array(F.lit(-1.0), F.lit(0.0))))["scale"] == 1.0


def test_vector_edges(spark):
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, V.argmax(F.array(F.lit(2), F.lit(5), F.lit(5)))) == 1
    assert one(spark, V.trapezoid(F.array(F.lit(3.0)))) == 3.0
    top = one(spark, V.top_k(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), 2))
    assert [t["i"] for t in top] == [1, 2]


def test_scalar_edges(spark):
    assert one(spark, S.class_from_stem(F.lit("great_pyrenees_12"))) == "great_pyrenees"
    assert one(spark, S.parse_node_id(F.lit("L3_T"))) is None
    assert one(spark, S.age_bucket(F.lit("unknown"))) is None and one(spark, S.age_bucket(F.lit("85.0"))) == 4
    assert one(spark, S.formatted(F.lit(float("nan")))) == "n/a"
    assert one(spark, S.lerp_angle(F.lit(3.0), F.lit(-3.0), F.lit(0.5))) == pytest.approx(math.pi, abs=1e-6)
    assert one(spark, S.region_words(F.lit(0.1), F.lit(0.9))) == "upper-right patches"
    assert one(spark, S.region_words(F.lit(None).cast("double"), F.lit(0.5))) == "attention hub"


def test_lattice_edges_of_a_cube(spark):
    n = spark.range(27).select(F.col("id").alias("node_id"), F.lit("b").alias("bundle_id"), F.floor(F.col("id") / 9).alias("z"), (F.floor(F.col("id") / 3) % 3).alias("y"), (F.col("id") % 3).alias("x"))
    assert lattice.edges(n).count() == 54
    assert lattice.edges(n, 26).count() == 158


def test_nearest_breaks_ties_low_and_skips_nulls(spark):
    book = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, -1.0])], "code bigint, w array<double>")
    df = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "k bigint, v array<double>")
    assert rows(dense.nearest(df, "k", "v", book, "code", "w").select("k", "code", "d2")) == [(7, 0, 2.0)]
    assert dense.nearest(df.limit(0), "k", "v", book, "code", "w").count() == 0


def test_vote_ties_go_to_the_smallest_label(spark):
    near = spark.createDataFrame([(1, 10), (1, 11)], "query bigint, neighbour bigint")
    labels = spark.createDataFrame([(10, 4), (11, 2)], "id bigint, label int")
    assert rows(dense.vote(near, labels, "id", "label")) == [(1, 2)]


def test_average_ranks_and_spearman(spark):
    df = spark.createDataFrame([("g", 1.0, 5.0), ("g", 2.0, 5.0), ("g", 2.0, 5.0)], "g string, a double, b double")
    assert [r.r for r in ordered.average_rank(df, ["g"], "a", "r").orderBy("a").collect()] == [0.0, 1.5, 1.5]
    assert ordered.spearman(df, ["g"], "a", "b").first().rho == 0.0


def test_hysteresis_keeps_its_state_in_the_band(spark):
    df = spark.createDataFrame(list(enumerate([0.5, 0.6, 0.52, 0.45, 0.4, 0.5])), "t bigint, v double").withColumn("k", F.lit(1))
    assert [r.visible for r in ordered.hysteresis(df, "k", ["t"], "v", 0.5).orderBy("t").collect()] == [False, True, True, True, False, False]


def test_ema_equals_the_fold(spark):
    values = [3.0, -1.0, 4.0, 1.5]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, t bigint, v double")
    placed = positions.with_position(df, "k", [F.col("t").asc()], "p", "n")
    state = 0.0
    for v in values:
        state += (v - state) * 0.3
    assert ordered.last_ema(placed, "k", "v", "p", "n", 0.3).first().ema == pytest.approx(state)


def test_label_propagation_and_modularity_find_two_cliques(spark):
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame(clique(range(5)) + clique(range(10, 15)) + [(4, 10, 0.1)], "a bigint, b bigint, w double")
    labels = {r.v: r.label for r in graph.label_propagation(edges).collect()}
    assert len({labels[v] for v in range(5)}) == 1 and len({labels[v] for v in range(10, 15)}) == 1 and labels[0] != labels[10]
    found = {r.v: r.community for r in graph.modularity_communities(edges.withColumn("g", F.lit("x")), "g").collect()}
    assert {found[v] for v in range(5)} == {0} and {found[v] for v in range(10, 15)} == {1}


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "a bigint, b bigint, w double")
    found = graph.shortest_paths(edges, spark.createDataFrame([(1,)], "v bigint"))
    assert rows(found) == [(1, 0.0), (2, 1.0), (3, 2.0)]


def test_shortest_paths_of_many_edges(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(68)], "a bigint, b bigint, w double")
    found = graph.shortest_paths(edges, spark.createDataFrame([(0,)], "v bigint"))
    assert rows(found) == [(i, float(i)) for i in range(69)]


def test_axis_refuses_one_group(spark):
    df = spark.createDataFrame([([1.0, 2.0], True)], "v array<double>, m boolean")
    with pytest.raises(ValueError):
        axis.build(df, "v", F.col("m"), 2)


def test_firing_rate_grid_has_zeros(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 0, -1.0), (2, 1, 2.0), (2, -1, 3.0)], "f bigint, c int, a double")
    assert rows(concepts.firing_rates(df, "f", "c", "a")) == [(1, 0, 0.5), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 1.0)]


def test_gate_without_live_features(spark):
    df = spark.createDataFrame([(1, [], 0.5)], "feature_id bigint, exemplars array<struct<image_id:string,token_idx:int>>, coherence double")
    r = concepts.quality_gate(df).first()
    assert (r.live, r.duplicate_rate, r.use_sae) == (0, 1.0, False)

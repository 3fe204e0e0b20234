"""Operators whose groups may hold any share of the rows, against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import concepts, cumulative, dense, graph, ordered, positions, quality, som, ward


@pytest.fixture
def skewed(spark):
    """One key holds a third of 3,000 rows, many have one row; ties, nulls and NaN among the values."""
    rng = np.random.default_rng(5)
    rows = [(("hot" if i % 3 == 0 else f"k{rng.integers(900)}"), i, float(rng.integers(40))) for i in range(3000)]
    rows += [(None, 3000, 1.0), (None, 3001, 1.0), ("hot", 3002, None), ("hot", 3003, float("nan"))]
    return spark.createDataFrame(rows, "k string, i bigint, x double").repartition(7), rows


def test_percentiles_of_groups_of_any_size(skewed):
    df, rows = skewed
    got = {r.k: (r.n, r.p05, r.p50, r.p95) for r in cumulative.exact_percentiles(df, ["k"], "x", (0.05, 0.5, 0.95)).collect()}
    values = {}
    for k, _, x in rows:
        if x is not None and x == x:
            values.setdefault(k, []).append(x)
    assert got == {k: (len(v), *map(pytest.approx, np.quantile(v, (0.05, 0.5, 0.95)))) for k, v in values.items()}
    one = cumulative.exact_percentiles(df, [], "x", (0.5,)).first()
    every = [x for v in values.values() for x in v]
    assert (one.n, one.p50) == (len(every), pytest.approx(np.median(every)))


def test_percentiles_within_a_relative_error_and_of_nothing(spark, skewed):
    df, rows = skewed
    state = cumulative.frequencies(df.filter("k = 'hot' AND x > 0 AND NOT isnan(x)"), ["k"], "x", relative_error=0.05)
    exact = np.quantile([x for k, _, x in rows if k == "hot" and x and x > 0], 0.5, method="lower")
    assert abs(cumulative.percentiles(state, ["k"], "x", (0.5,)).first().p50 - exact) <= 0.06 * exact + 1
    assert cumulative.exact_percentiles(df.limit(0), ["k"], "x", (0.5,)).count() == 0


def test_average_ranks_with_ties_in_a_hot_group(skewed):
    df, rows = skewed
    got = {r.i: r.r for r in ordered.average_rank(df.filter("x IS NOT NULL AND NOT isnan(x)"), ["k"], "x", "r").collect()}
    for k in ("hot", None):
        own = [(i, x) for key, i, x in rows if key == k and x is not None and x == x]
        for i, x in own:
            assert got[i] == sum(y < x for _, y in own) + (sum(y == x for _, y in own) - 1) / 2


def test_states_are_carried_over_partitions(spark, skewed):
    df, rows = skewed
    got = {r.i: r.visible for r in ordered.hysteresis(df, "k", ["i"], "x", 20.0, margin=15.0).collect()}
    state = {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        if x is not None and (x > 35 or x != x):  # NaN is larger than any number
            state[k] = True
        elif x is not None and x <= 5:
            state[k] = False
        assert got[i] == state.get(k, False), (k, i)


def test_last_known_of_a_group_without_values(spark):
    rows = [("a", i, None) for i in range(50)] + [("b", 60, True)] + [("b", 61 + i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i bigint, v boolean")
    got = {(r.k, r.i): r.s for r in positions.last_known(df, "k", [F.col("i").asc()], "v", "s").collect()}
    assert all(s is (None if k == "a" else True) for (k, _), s in got.items()) and len(got) == 101


@pytest.mark.parametrize("few", [0, 10**9])
def test_hot_keys_are_joined_where_they_lie(spark, monkeypatch, few):
    monkeypatch.setattr(positions, "FEW_ROWS", few)
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(-1, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, positions.join_hot(left, right, ["k"], how, rows=4000).collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_a_checkpoint_folder_is_asked_for_on_clusters(spark):
    class Cluster:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        positions.shared_folder(Session())


def odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.1]), (None, [1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)


def test_vectors_that_cannot_be_measured_have_no_neighbours(spark):
    book = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [float("nan"), 0.0])], "code bigint, w array<double>")
    near = dense.nearest(odd_vectors(spark), "id", "v", book, "code", "w")
    assert sorted((r.id, r.code) for r in near.collect()) == [(1, 0), (2, 1), (9, 0)]
    every = dense.nearest(odd_vectors(spark), "id", "v", book, "code", "w", k=None)
    assert every.count() == 6
    pairs = dense.cosine_neighbours(odd_vectors(spark).filter("size(v) = 2 AND id IS NOT NULL"), odd_vectors(spark), "id", "v", 1)
    assert {(r.query, r.neighbour) for r in pairs.collect()} == {(1, 9), (2, 9), (9, 1)}
    with pytest.raises(ValueError, match="values"):
        dense.nearest(odd_vectors(spark), "id", "v", spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "code bigint, w array<double>"), "code", "w")


def test_a_codebook_of_twenty_is_whole(spark):
    book = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "code bigint, w array<double>")
    rows = spark.createDataFrame([(1, [3.2, 0.0])], "id bigint, v array<double>")
    near = dense.nearest(rows, "id", "v", book, "code", "w", k=None)
    assert near.count() == 20 and near.filter("place = 1").first().code == 3


def test_long_paths_are_walked_to_their_end(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(80)] + [(0, 60, 500.0), (900, 901, 1.0)], "a bigint, b bigint, w double")
    source = spark.createDataFrame([(0,)], "v bigint")
    got = {r.v: r.distance for r in graph.shortest_paths(edges, source).collect()}
    assert got == {i: float(i) for i in range(81)}


def test_routes_of_a_weighted_graph(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (2, 3, 1.0), (1, 3, 2.0), (8, 9, 1.0)], "a bigint, b bigint, w double")
    v = lambda *ids: spark.createDataFrame([(i,) for i in ids], "v bigint")
    got = sorted((r.target, r.place, r.v) for r in graph.routes(edges, v(0), v(3, 0, 9)).collect())
    assert got == [(0, 0, 0), (3, 0, 3), (3, 1, 1), (3, 2, 0)]


def test_paths_of_small_graphs_are_those_of_large_ones(spark):
    rng = np.random.default_rng(3)
    rows = [("g", int(a), int(b), float(rng.integers(1, 5))) for a, b in rng.integers(0, 40, (90, 2))] + [("h", 100, 101, 2.0), ("h", 103, 104, 1.0)]
    edges = spark.createDataFrame(rows, "g string, a bigint, b bigint, w double")
    sources = spark.createDataFrame([("g", 0), ("g", 7), ("h", 100)], "g string, v bigint")
    small = graph.small_paths(edges, "g", sources)
    got = {r.v: r.distance for r in small.collect()}
    assert got == {r.v: r.distance for r in graph.shortest_paths(edges.select("a", "b", "w"), sources.select("v")).collect()}
    targets = spark.createDataFrame([("g", max(v for v in got if v < 100)), ("h", 101), ("h", 104)], "g string, v bigint")
    routes = sorted(map(tuple, graph.small_routes(small, "g", targets).collect()))
    assert routes == sorted((r.target, r.place, r.v) for r in graph.routes(edges.select("a", "b", "w"), sources.select("v"), targets.select("v")).collect())


def test_modularity_finds_cliques_on_higher_levels(spark):
    """A ring of thirty triangles in ten groups: moving nodes alone stops too early."""
    edges = []
    for t in range(30):
        a = 3 * t
        edges += [(a, a + 1), (a + 1, a + 2), (a, a + 2), (a + 2, (a + 3) % 90)]
        edges += [(a, a + 4)] if t % 3 != 2 else []
    df = spark.createDataFrame([("g", int(a), int(b), 1.0) for a, b in edges], "g string, a bigint, b bigint, w double")
    labels = graph.modularity_communities(df, "g")
    q = graph.modularity(df, labels, "g").first().q
    own = {r.v: r.community for r in labels.collect()}
    m, degree = len(edges), {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    want = sum(own[a] == own[b] for a, b in edges) / m - sum(sum(degree[v] for v in own if own[v] == c) ** 2 for c in set(own.values())) / (4 * m * m)
    assert q == pytest.approx(want) and q > 0.6 and len(set(own.values())) <= 12


@pytest.mark.parametrize("block", [2, 512])
def test_keys_of_many_units_meet_block_by_block(spark, block):
    rng = np.random.default_rng(1)
    rows = [(k, u, float(rng.random())) for k, n in ((1, 9), (2, 1), (3, 4)) for u in range(n)]
    df = spark.createDataFrame(rows, "k bigint, u bigint, x double")
    got = {(r.i, r.j): r.c for r in concepts.coactivation(df, "k", "u", "x", block).collect()}
    want = {}
    for k, i, x in rows:
        for other, j, y in rows:
            if k == other and i <= j:
                want[i, j] = want.get((i, j), 0) + x * y / 3
    assert got == {p: pytest.approx(v) for p, v in want.items()}


def test_ward_merges_what_costs_least(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 12))
    x = np.concatenate([c + rng.normal(size=(4, 12)) * 0.1 for c in centres])
    r = np.corrcoef(x)
    pairs = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(12) for j in range(i, 12)], "i bigint, j bigint, r double")
    activity = spark.createDataFrame([(i, 1.0) for i in range(12)] + [(99, 0.001)], "unit bigint, mean double")
    got = {row.unit: row.concept for row in concepts.concept_clusters(pairs, activity, concepts=3).collect()}
    assert got == {i: i // 4 for i in range(12)}
    # against a plain agglomeration: always the pair of sets whose union adds the least squared distance
    sets = [[i] for i in range(12)]
    spread = lambda s: ((r[s] - r[s].mean(axis=0)) ** 2).sum()
    while len(sets) > 5:
        a, b = min(((a, b) for a in range(len(sets)) for b in range(a)), key=lambda p: spread(sets[p[0]] + sets[p[1]]) - spread(sets[p[0]]) - spread(sets[p[1]]))
        sets[b] += sets.pop(a)
    found = {}
    for row in concepts.concept_clusters(pairs, activity, concepts=5, least_units=1).collect():
        found.setdefault(row.concept, []).append(row.unit)
    assert sorted(map(sorted, sets)) == sorted(map(sorted, found.values()))


@pytest.mark.parametrize("most, block", [(4096, 2048), (6, 5), (1, 2048), (1, 1)])
def test_ward_of_more_units_than_one_task_holds(spark, monkeypatch, most, block):
    monkeypatch.setattr(ward, "WARD_UNITS", most)
    monkeypatch.setattr(ward, "BLOCK_UNITS", block)
    rng = np.random.default_rng(5)
    r = np.corrcoef(rng.normal(size=(24, 6))) * (rng.random((24, 24)) < 0.5)
    r = np.triu(r) + np.triu(r, 1).T
    r[20:] = r[:, 20:] = 0  # units without an entry: all merges among them cost the same
    pairs = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(24) for j in range(i, 24) if r[i, j]], "i bigint, j bigint, r double")
    activity = spark.createDataFrame([(i, 1.0) for i in range(24)], "unit bigint, mean double")
    got = {}
    for row in concepts.concept_clusters(pairs, activity, concepts=7, least_units=1).collect():
        got.setdefault(row.concept, []).append(row.unit)
    sets = [[i] for i in range(24)]
    spread = lambda s: ((r[s] - r[s].mean(axis=0)) ** 2).sum()
    while len(sets) > 7:
        a, b = min(((a, b) for a in range(len(sets)) for b in range(a)), key=lambda p: spread(sets[p[0]] + sets[p[1]]) - spread(sets[p[0]]) - spread(sets[p[1]]))
        sets[b] += sets.pop(a)
    assert sorted(map(sorted, sets)) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("concepts_left", [2, 9])
def test_ward_of_equal_costs_is_the_same_in_blocks(spark, monkeypatch, concepts_left):
    pairs = spark.createDataFrame([(i, i, 1.0) for i in range(40)] + [(i, i + 1, 0.5) for i in range(0, 20, 2)], "i bigint, j bigint, r double")
    activity = spark.createDataFrame([(i, 1.0) for i in range(40)], "unit bigint, mean double")
    clusters = lambda: {(row.unit, row.concept) for row in concepts.concept_clusters(pairs, activity, concepts_left, least_units=1).collect()}
    whole = clusters()
    monkeypatch.setattr(ward, "WARD_UNITS", 3)
    monkeypatch.setattr(ward, "BLOCK_UNITS", 16)
    assert clusters() == whole and len(whole) == 40 and len({c for _, c in whole}) == concepts_left


def test_ward_in_blocks_writes_the_matrix_a_few_times_only(spark, monkeypatch):
    monkeypatch.setattr(ward, "WARD_UNITS", 100)
    monkeypatch.setattr(ward, "BLOCK_UNITS", 40)
    n, rng = 400, np.random.default_rng(7)
    r = rng.random((n, n)) / 50 + (np.arange(n)[:, None] // 40 == np.arange(n) // 40)
    pairs = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(n) for j in range(i, n)], "i bigint, j bigint, r double")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
    before = written()
    assert list(ward.ward(pairs, np.arange(n), 10)) == [i // 40 * 40 for i in range(n)]
    assert written() - before < 4 * 12 * n * n  # an entry is 12 bytes; every block meets all ten in every round


@pytest.mark.parametrize("sent", [10, 0])
def test_correlated_is_the_correlation_of_coactivation(spark, monkeypatch, sent):
    monkeypatch.setattr(concepts, "UNITS_SENT", sent)
    rng = np.random.default_rng(1)
    rows = [(k, u, float(rng.random())) for k, n in ((1, 9), (2, 1), (3, 4), (None, 5)) for u in range(n)]
    df = spark.createDataFrame(rows, "k bigint, u bigint, x double")
    pairs, activity = concepts.correlated(df, "k", "u", "x")
    want = {(r.i, r.j): pytest.approx(r.r, abs=1e-12) for r in concepts.correlation(concepts.coactivation(df, "k", "u", "x")).collect()}
    assert {(r.i, r.j): r.r for r in pairs.collect()} == want
    assert {r.unit: r.mean for r in activity.collect()} == {u: pytest.approx(np.mean([x for _, v, x in rows if v == u])) for u in range(9)}


def test_ranked_quality_of_all_rows_equals_the_sample_of_all(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in v], [float(x) for x in v[:2]]) for i, v in enumerate(rng.normal(size=(90, 8)))], "id bigint, h array<double>, l array<double>")
    a = quality.trustworthiness(rows, "id", "h", "l").first()
    monkeypatch.setattr(dense, "BLOCK_ROWS", 25)
    b = quality.trustworthiness(rows, "id", "h", "l", rows=None).first()
    assert (a.n, a.trustworthiness, a.continuity) == (b.n, pytest.approx(b.trustworthiness), pytest.approx(b.continuity))
    assert quality.trustworthiness(rows.limit(3), "id", "h", "l", rows=None).first().n == 3


@pytest.mark.parametrize("few", [0, 2048])
def test_map_steps_of_large_and_small_maps_are_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(som, "FEW_UNITS", few)
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(60, 4)), rng.normal(size=(8, 4))
    place = np.array([(z, y, v) for z in (0, 1) for y in (0, 1) for v in (0, 1)])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    units = spark.createDataFrame([(i, *map(int, place[i]), [float(v) for v in w[i]]) for i in range(8)], "code bigint, z bigint, y bigint, x bigint, w array<double>")
    best = ((x[:, None] - w[None]) ** 2).sum(axis=2).argmin(axis=1)
    h = np.exp(-((place[:, None] - place[best][None]) ** 2).sum(axis=2) / 2)
    want = w + 0.5 * (h @ x / h.sum(axis=1)[:, None] - w)
    got = np.array([r.w for r in som.batch_step(rows, "id", "v", units, 1.0, 4).orderBy("code").collect()])
    assert np.allclose(got, want)


def test_dead_units_take_seeded_rows(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id bigint, v array<double>")
    units = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1e9, 0.0]), (2, [-1e9, 0.0])], "code bigint, w array<double>")
    first, again = ({r.code: tuple(r.w) for r in som.revived(rows, "id", "v", units).collect()} for _ in range(2))
    assert first == again and first[0] == (0.0, 0.0) and {first[1], first[2]} <= {(float(i), 0.0) for i in range(5)}


def test_projections_by_name(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in range(9)], "id bigint, v array<double>")
    got = quality.projections(rows, "id", "v", ["random", "tsne"], seed=3)
    assert got.count() == 9 and got.exceptAll(quality.projections(rows, "id", "v", ["random"], seed=3)).count() == 0
    with pytest.raises(ValueError, match="polar"):
        quality.projections(rows, "id", "v", ["polar"])

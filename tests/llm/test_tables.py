import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import forest, quantiles, splits, topn
from quillon.operators import positions

REFS = "feature_id bigint, image_id string, token_idx int, activation double, position int, e string"
FEATURES = "feature_id bigint, exemplars array<struct<image_id:string,token_idx:int,activation:double,class_label:int>>, activation string"


def test_top_items_with_ties_repeats_and_nulls(spark):
    inf, nan = float("inf"), float("nan")
    refs = [(1, "b", 1, 2.0), (1, "a", 2, 2.0), (1, "a", 1, 2.0), (1, "a", 1, 1.0), (1, "c", 1, nan), (1, "d", 1, inf), (1, "f", 1, -1.0), (1, "g", 1, 0.0), (1, None, 1, 9.0), (1, "h", None, 9.0), (None, "h", 1, 9.0), (1, "é", 1, 2.0), (1, "Z", 1, 2.0)]
    kept = [(1, [("new", 3, 5.0, 1), None, ("a", 2, None, 1)], "x"), (2, None, "x"), (3, [], "x")]
    got = topn.top_exemplars(spark.createDataFrame([(*r, 0, "x") for r in refs], REFS), spark.createDataFrame(kept, FEATURES), n=5)
    assert [(r.image_id, r.token_idx) for r in got.orderBy("position").collect()] == [("new", 3), ("Z", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_a_group_with_a_third_of_all_rows(spark):
    rng = random.Random(1)
    refs = [(7 if rng.random() < 0.4 else rng.randrange(50), f"i{rng.randrange(4000)}", rng.randrange(9), float(rng.randrange(30)), 0, "") for _ in range(6000)]
    got = topn.top_exemplars(spark.createDataFrame(refs, REFS).repartition(7), spark.createDataFrame([], FEATURES), n=10)
    items = {}
    for f, i, t, a, _, _ in refs:
        if a > 0:
            items[f, i, t] = max(a, items.get((f, i, t), 0))
    want = set()
    for f in {k[0] for k in items}:
        want |= {k for k, _ in sorted(((k, a) for k, a in items.items() if k[0] == f), key=lambda x: (-x[1], x[0][1].encode(), x[0][2]))[:10]}
    assert {(r.feature_id, r.image_id, r.token_idx) for r in got.collect()} == want


def test_no_rows_no_items(spark):
    assert topn.top_exemplars(spark.createDataFrame([], REFS), spark.createDataFrame([], FEATURES)).count() == 0


def test_percentiles_equal_numpy_for_states_put_together(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=4000).round(2), "one": np.array([3.0]), "tied": np.repeat(5.0, 200), None: np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, x double")
    parts = [quantiles.frequencies(df.filter(F.pmod(F.xxhash64("x"), F.lit(3)) == i), ["g"], "x") for i in range(3)]
    got = {r.g: r for r in quantiles.percentiles(quantiles.combine(*parts), ["g"], "x").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].n == len(x)
        for level in quantiles.LEVELS:
            assert got[g][f"p{round(level * 100):02d}"] == pytest.approx(np.quantile(x, level))


def test_percentiles_with_a_bounded_error(spark):
    x = np.random.default_rng(3).lognormal(size=5000)
    state = quantiles.frequencies(spark.createDataFrame([("a", float(v)) for v in x], "g string, x double"), ["g"], "x", relative_error=0.02)
    assert state.count() < 300
    r = quantiles.percentiles(state, ["g"], "x").first()
    for level in quantiles.LEVELS:
        assert r[f"p{round(level * 100):02d}"] == pytest.approx(np.quantile(x, level), rel=0.025)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert quantiles.percentiles(quantiles.frequencies(empty, ["g"], "x"), ["g"], "x").count() == 0


def components(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in root}


@pytest.mark.parametrize("seed", [0, 1])
def test_forest_spans_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5200)]  # a path and a star
    df = spark.createDataFrame([*edges, (1, None), (None, 2), (9, 9)], "a bigint, b bigint")
    labels, tree = forest.spanning_forest(df)
    want = components([(a, b) for a, b in edges if a != b])
    assert {r.v: r.root for r in labels.collect()} == want
    kept = [(r.a, r.b) for r in tree.collect()]
    assert len(kept) == len(set(kept)) == len(want) - len(set(want.values())) and components(kept) == want


META = "row_id bigint, dataset_id string, image_id string, lesion_id string, dx string, `text:x` string, split string"
CONFIG = "dataset_id string, label_column string, group_column string, splits struct<train:double,val:double,test:double,seed:int>"


def test_related_rows(spark):
    rows = [(1, "d1", "IMG_1", "LX 7", "nv"), (2, "d1", "img-1", None, "nv"), (3, "d1", "img2", "lx-7", "nv"), (4, "d1", "img3", "N/A", None), (5, "d1", "img4", "n/a ", "mel"), (6, "d2", "img1", "LX7", "x"), (7, "d1", None, "", "x"), (8, "d1", "?", None, "x"), (9, "gone", "q", "LX7", None), (10, "gone", "Q", None, None), (None, "d1", "img2", "z", "x"), (3, "d1", "img2", "lx-7", "nv")]
    config = [("d1", "dx", "lesion_id", (0.5, 0.25, 0.25, 3)), ("d2", None, None, (0.8, 0.1, 0.1, 1))]
    got = splits.related(spark.createDataFrame([(*r, "t", "s") for r in rows], META), spark.createDataFrame(config, CONFIG))[0]
    assert {(r.row_id, r.group_id) for r in got.filter("together").collect()} == {(1, 1), (2, 1), (3, 1), (9, 9), (10, 9)}
    assert got.count() == 10


def test_splits_hold_groups_together_and_meet_proportions(spark):
    rng = random.Random(4)
    rows = [(i, "d1", f"i{i}", f"g{0 if rng.random() < 0.05 else rng.randrange(900)}", rng.choice("ab"), "", "") for i in range(4000)]
    config = spark.createDataFrame([("d1", "dx", "lesion_id", (0.7, 0.2, 0.1, 9))], CONFIG)
    df = spark.createDataFrame(rows, META)
    got = splits.assign_splits(df, config).cache()
    assert got.count() == 4000 and got.groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r.split: r["count"] / 4000 for r in got.groupBy("split").count().collect()}
    assert share["train"] == pytest.approx(0.7, abs=0.05) and share["val"] == pytest.approx(0.2, abs=0.05) and share["test"] == pytest.approx(0.1, abs=0.05)
    again = splits.assign_splits(df.orderBy(F.rand(2)), config)
    assert got.exceptAll(again).count() == 0


def test_splits_of_nothing(spark):
    empty, config = spark.createDataFrame([], META), spark.createDataFrame([], CONFIG)
    assert splits.assign_splits(empty, config).count() == 0 and splits.related(empty, config)[0].count() == 0


@pytest.fixture
def hot(monkeypatch):
    """Every join treats keys of more than a thousandth of the rows as hot, however few rows there are."""
    monkeypatch.setattr(positions, "FEW_ROWS", 0)


def test_forest_and_groups_with_hot_keys(spark, hot, tmp_path):
    edges = [(1, x) for x in range(2, 400)] + [(x, 1000 + x) for x in range(2, 60)] + [(7000, 7001)]
    labels, tree = forest.spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = components(edges)
    assert {r.v: r.root for r in labels.collect()} == want
    kept = forest.write_forest(tree, str(tmp_path / "forest"))
    assert kept.count() == len(want) - 2
    # a third of the rows share one group, another third one image
    rows = [(i, "d1", f"i{i}" if i % 3 else "one", "g" if i % 3 == 1 else f"g{i}", "a", "", "") for i in range(1, 601)]
    config = spark.createDataFrame([("d1", "dx", "lesion_id", (0.7, 0.2, 0.1, 9))], CONFIG)
    got, tree = splits.related(spark.createDataFrame(rows, META), config)
    groups = {r.row_id: r.group_id for r in got.collect()}
    assert groups == {i: 3 if i % 3 == 0 else 1 if i % 3 == 1 else i for i in range(1, 601)}
    assert tree.count() == 2 * 199
    assert splits.assign_splits(spark.createDataFrame(rows, META), config).count() == 600


def test_forest_of_nothing(spark):
    labels, tree = forest.spanning_forest(spark.createDataFrame([(3, 3), (None, 1)], "a bigint, b bigint"))
    assert labels.count() == 0 and tree.count() == 0

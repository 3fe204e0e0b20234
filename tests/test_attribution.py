import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import random as R
from quillon.operators import attribution as A
from quillon.operators import som


def test_rollout_equals_matrix_products(spark):
    rng = np.random.default_rng(0)
    layers = rng.dirichlet(np.ones(4), size=(3, 4))
    rows = [("i", layer, d, s, float(layers[layer, d, s])) for layer in range(3) for d in range(4) for s in range(4)]
    got = A.rollout(spark.createDataFrame(rows, "image string, layer int, dst int, src int, w double")).orderBy("token").collect()
    want = np.eye(4)
    for a in layers:
        a = 0.5 * a + 0.5 * np.eye(4)
        want = a / a.sum(axis=1, keepdims=True) @ want
    assert [r.score for r in got] == pytest.approx(want[0])


def test_relevance_takes_the_positive_part(spark):
    rows = [("i", 0, h, 0, 1, 1.0, g) for h, g in ((0, 2.0), (1, -4.0))] + [("i", 0, 0, 1, 1, 0.0, 0.0)]
    got = {r.token: r.score for r in A.relevance(spark.createDataFrame(rows, "image string, layer int, head int, dst int, src int, w double, g double")).collect()}
    assert got == {0: 1.0, 1: 1.0}


@pytest.mark.parametrize(("n", "steps"), [(7, 3), (2, 5), (10, 5)])
def test_masking_runs_are_near_equal(spark, n, steps):
    df = spark.createDataFrame([("i", t, float(n - t)) for t in range(n)], "image string, token int, score double")
    got = [r.step for r in A.masking_steps(df, "image", "token", "score", steps).orderBy("token").collect()]
    assert got == [i for i, part in enumerate(np.array_split(np.arange(n), steps)) for _ in part]


def test_deletion_curve_uses_the_given_scorer(spark):
    df = spark.createDataFrame([("i", t, float(t)) for t in range(4)], "image string, token int, score double")
    curve = A.deletion_curve(df, "image", "token", "score", 2, lambda m: m.withColumn("p", 1 - F.size("masked") / 4))
    assert [(r.step, r.p) for r in curve.orderBy("step").collect()] == [(0, 1.0), (1, 0.5), (2, 0.0)]


def test_aggregate_expressions(spark):
    df = spark.createDataFrame([(1.0, -3.0), (2.0, 1.0)], "a double, w double")
    r = df.agg(A.weighted_maps(F.col("a"), F.col("w")).alias("m"), A.path_attribution(F.col("a"), F.lit(0.5), F.col("w")).alias("p"), A.constancy(F.col("a")).alias("c")).first()
    assert (r.m, r.p, r.c) == (0.0, -1.5, False)


def test_batch_step_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(30, 3)), rng.normal(size=(4, 3))
    grid = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k bigint, v array<double>")
    units = spark.createDataFrame([(i, *grid[i], w[i].tolist()) for i in range(4)], "code bigint, z int, y int, x int, w array<double>")
    best = ((x[:, None] - w[None]) ** 2).sum(axis=2).argmin(axis=1)
    h = np.exp(-np.array([[sum((a - b) ** 2 for a, b in zip(p, q)) for q in grid] for p in grid]) / (2 * 0.8**2))
    want = w + 0.5 * ((h[:, best] @ x) / h[:, best].sum(axis=1, keepdims=True) - w)
    got = som.batch_step(rows, "k", "v", units, 0.8, 3).orderBy("code").collect()
    assert np.allclose([r.w for r in got], want)
    far = units.withColumn("w", F.when(F.col("code") == 3, F.array(*[F.lit(99.0)] * 3)).otherwise(F.col("w")))
    assert som.revived(rows, "k", "v", far).filter("code = 3").first().w in x.tolist()


def test_sparse_codes(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k bigint, v array<double>")
    got = som.sparse_codes(rows, "k", "v", np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), np.zeros(2), 2)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2.0), (1, 0, 1.0)}


def test_generator_is_seeded_and_uniform(spark):
    got = spark.createDataFrame([(7, 500)], "s bigint, n int").select(R.seeded(F.col("s"), F.col("n")).alias("x")).first().x
    assert got == R.sequence_of(7, 500) and 0.4 < np.mean(got) < 0.6 and len(set(got)) == 500

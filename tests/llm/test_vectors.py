import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import cells, clusters, neighbours
from quillon.operators import positions

SCHEMA = "id bigint, vec array<float>, cell int, v string, h1 string"


def frame(spark, vectors, first=1):
    rows = [(first + i, None if v is None else [float(x) for x in v], 0, "x", "y") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def planted(seed=3, groups=40, noise=300):
    """Unit vectors in groups of similarity about 0.93, some almost equal pairs, and noise."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(3 + g % 9):
            out.append(centre + rng.normal(size=64) * 0.032)
        out.append(out[-1] + rng.normal(size=64) * 0.004)
    out += list(rng.normal(size=(noise, 64)))
    return [v * rng.uniform(0.1, 50) for v in out]


def unusable():
    return [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]


def brute(vectors, first=1):
    x = np.array(vectors, "float32").astype("float64")
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return s


def test_pairs_equal_brute_force(spark):
    vectors = planted()
    s = brute(vectors)
    top = [set(np.argsort(-row, kind="stable")[:10]) for row in s]
    want = {(i + 1, j + 1) for i in range(len(s)) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.985}
    df = frame(spark, vectors + unusable()).unionByName(frame(spark, vectors[:5]))  # repeated rows count once
    got = {(r.a, r.b) for r in neighbours.mutual_pairs(df, "id", "vec", 0.985).collect()}
    assert len(want) > 30 and got == want


def test_pairs_of_a_dense_group_equal_brute_force(spark, monkeypatch):
    """A third of the rows are near copies of one vector: all their partners are met, over several blocks too."""
    monkeypatch.setattr(neighbours, "RESIDENT_BLOCK", 700)
    monkeypatch.setattr(neighbours, "ASKER_BLOCK", 900)
    monkeypatch.setattr(neighbours, "RESIDENTS", 60)
    rng = np.random.default_rng(11)
    one = rng.normal(size=64)
    near = one / np.linalg.norm(one) + rng.normal(size=(2000, 64)) * 0.0125
    vectors = [*near, *rng.normal(size=(4000, 64))]
    x = np.array(vectors, "float32").astype("float64")
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("float32").astype("float64")  # as stored
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    top = [set(np.argsort(-row, kind="stable")[:10]) for row in s]
    want = {(i + 1, j + 1) for i in range(len(s)) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.985}
    got = {(r.a, r.b) for r in neighbours.mutual_pairs(frame(spark, vectors), "id", "vec", 0.985).collect()}
    assert len(want) > 1000 and got == want


def test_all_neighbours_recall(spark):
    vectors = planted(5)
    s = brute(vectors)
    got = {}
    for r in neighbours.stated_neighbours(frame(spark, vectors), "id", "vec", every=5).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id - 1)
    assert set(got) == {i for i in range(1, len(s) + 1) if i % 5 == 0}
    recall = np.mean([len(got[i] & set(np.argsort(-s[i - 1], kind="stable")[:10])) / 10 for i in got])
    assert recall >= 0.9


def test_many_equal_vectors_keep_the_smallest_ids(spark):
    same, other = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    df = frame(spark, [same] * 30 + [other])
    got = {(r.a, r.b) for r in neighbours.mutual_pairs(df, "id", "vec", 0.985).collect()}
    assert got == {(a, b) for a in range(1, 12) for b in range(a + 1, 12)}
    lists = {}
    for r in neighbours.neighbour_pairs(df, "id", "vec").orderBy("a", "place").collect():
        lists.setdefault(r.a, []).append(r.b)
    assert set(lists) == set(range(1, 32))  # every copy has its list
    assert all(lists[a] == [b for b in range(1, 12) if b != a][:10] for a in range(1, 31))
    asked = {r.a for r in neighbours.neighbour_pairs(df, "id", "vec", every=10).collect()}
    assert asked == {10, 20, 30}


@pytest.mark.parametrize("sub_cells", [1, 8, 32])
def test_pairs_of_two_levels_equal_brute_force(spark, sub_cells):
    """The second level of cells, as large tables have it: no pair is lost to it."""
    vectors = planted(7, 60, 600)
    s = brute(vectors)
    top = [set(np.argsort(-row, kind="stable")[:10]) for row in s]
    want = {(i + 1, j + 1) for i in range(len(s)) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.985}
    got = {(r.a, r.b) for r in neighbours.mutual_pairs(frame(spark, vectors), "id", "vec", 0.985, sub_cells=sub_cells).collect()}
    assert len(want) > 50 and got == want


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_rows(spark, count):
    df = frame(spark, [[1.0] * 64] * count)
    assert neighbours.mutual_pairs(df, "id", "vec", 0.985).count() == (count == 2)
    assert clusters.cluster(df, "id", "vec").count() == 0
    assert clusters.described(df, "id", "vec").count() == 0


def test_anisotropic_codes_lower_the_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1)[:, None]
    book = neighbours.fit_codebook(x, x)
    plain, aware = neighbours.encode(x, x, book, sweeps=0), neighbours.encode(x, x, book, sweeps=2)
    decode = lambda c: book[np.arange(neighbours.SUBSPACES), c].reshape(len(x), 64)
    along = lambda c: np.abs(((x - decode(c)) * x).sum(axis=1)).mean()
    assert along(aware) < 0.6 * along(plain)


def test_table_scores_rank_like_decoded_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)).astype("float32")
    book = neighbours.fit_codebook(x, x)
    codes = neighbours.encode(x, x, book)
    q = rng.normal(size=(5, 64)).astype("float32")
    scores = neighbours.table_scores(q, codes, book).astype("float64").T
    exact = q @ book[np.arange(neighbours.SUBSPACES), codes].reshape(300, 64).T
    assert min(np.corrcoef(a, b)[0, 1] for a, b in zip(scores, exact)) > 0.9999


def test_clusters_equal_brute_force(spark):
    vectors = planted(9)
    s = brute(vectors)
    want, seen = set(), set()
    for i in range(len(s)):
        members = [i, *np.flatnonzero(s[i] >= 0.8)]
        if i not in seen and len(members) >= 3:
            want |= {(int(m) + 1, min(members) + 1) for m in members}
        seen |= set(members)
    df = frame(spark, vectors + unusable()).unionByName(frame(spark, vectors[:5]))
    got = {(r.id, r.cluster_id) for r in clusters.cluster(df, "id", "vec").collect()}
    assert want and got == want


def test_copies_form_a_cluster_and_are_described(spark):
    df = frame(spark, [[1.0] * 64] * 4 + [[1.0] * 32 + [-1.0] * 32] * 2)
    assert {(r.id, r.cluster_id) for r in clusters.cluster(df, "id", "vec").collect()} == {(i, 1) for i in range(1, 5)}
    r = clusters.described(df, "id", "vec").first()
    assert (r.cluster_id, r["size"], r.typical_ids, r.medoid_similarity) == (1, 4, [1, 2, 3], 1.0)


@pytest.mark.parametrize("few", [None, 0])
def test_clusters_of_cells_in_parts_equal_brute_force(spark, monkeypatch, few):
    """Cells are cut into parts of a few rows, so clusters lie in many parts; joins take their way for hot keys."""
    monkeypatch.setattr(clusters, "PART_ROWS", 40)
    monkeypatch.setattr(clusters, "RESIDENTS", 400)
    if few is not None:
        monkeypatch.setattr(positions, "FEW_ROWS", few)
    rng = np.random.default_rng(21)
    one = rng.normal(size=64)
    one /= np.linalg.norm(one)
    vectors = [*planted(9, 20, 100), *(one + rng.normal(size=(250, 64)) * 0.02), *([one] * 30)]
    s = brute(vectors)
    want = {(i + 1, int(min(i, *np.flatnonzero(row >= 0.8))) + 1) for i, row in enumerate(s) if (row >= 0.8).sum() >= 2}
    got = {(r.id, r.cluster_id) for r in clusters.cluster(frame(spark, vectors), "id", "vec").collect()}
    assert got == want


@pytest.mark.parametrize("part", [20, 8192])
def test_merged_sets_hold_similar_vectors_only(spark, monkeypatch, part):
    """Chains run through many cells: whatever is merged, no set has a pair that is not similar."""
    monkeypatch.setattr(clusters, "PART_ROWS", part)
    monkeypatch.setattr(clusters, "RESIDENTS", 8)
    rng = np.random.default_rng(2)
    chains = []
    for _ in range(12):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        chains += [np.cos(t) * a + np.sin(t) * b for t in np.radians(np.arange(0, 180, 6) + rng.uniform(0, 3, 30))]
    s = brute(chains)
    sets = {}
    for r in clusters.cluster(frame(spark, chains), "id", "vec", smallest=2).collect():
        sets.setdefault(r.cluster_id, []).append(r.id - 1)
    assert len(sets) > 40 and all(s[i, j] >= 0.8 - 1e-6 for own in sets.values() for i in own for j in own if i != j)
    assert all(min(own) + 1 == name for name, own in sets.items())


def test_sets_do_not_depend_on_cells_and_parts(spark, monkeypatch):
    """Chains, and a fan of vectors in a cone, come out divided the same however many cells and parts they are cut into."""
    rng = np.random.default_rng(12)
    vectors = []
    for _ in range(6):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        vectors += [np.cos(t) * a + np.sin(t) * b for t in np.radians(rng.uniform(0, 150, 40))]
    centre, cone = rng.normal(size=64), rng.normal(size=(160, 64))
    vectors += list(centre / np.linalg.norm(centre) + 0.5 * cone / np.linalg.norm(cone, axis=1)[:, None])
    s = brute(vectors)
    np.fill_diagonal(s, 1)
    near, want, seen = s >= 0.8, set(), np.zeros(len(s), bool)
    for i in range(len(s)):
        chain = np.arange(len(s)) == i
        while not seen[i] and (near[chain].any(axis=0) != chain).any():
            chain = near[chain].any(axis=0)
        seen |= chain
        members = np.flatnonzero(chain)
        while len(members) > 1:
            own = [members[near[np.ix_(members, members)].sum(axis=1).argmax()]]
            left = members[near[own[0], members] & (members != own[0])]
            while len(left):
                own.append(left[s[np.ix_(left, own)].sum(axis=1).argmax()])
                left = left[near[own[-1], left] & (left != own[-1])]
            want |= {(int(m) + 1, int(min(own)) + 1) for m in own if len(own) > 1}
            members = np.setdiff1d(members, own)
    for part, residents in ((8192, 1000), (30, 1000), (30, 40)):
        monkeypatch.setattr(clusters, "PART_ROWS", part)
        monkeypatch.setattr(clusters, "RESIDENTS", residents)
        assert {(r.id, r.cluster_id) for r in clusters.cluster(frame(spark, vectors), "id", "vec", smallest=2).collect()} == want


def test_points_make_a_core_point():
    """With three points to a core, two alone are no cluster, and one in reach of a core belongs to it."""
    x = np.zeros((6, 64), "float32")
    for i, t in enumerate(np.radians([0, 8, 16, 50, 90, 98])):
        x[i, 0], x[i, 1] = np.cos(t), np.sin(t)
    assert sorted(map(sorted, clusters.local_clusters(x, 0.95, points=3))) == [[0, 1, 2]]
    assert sorted(map(sorted, clusters.local_clusters(x, 0.95))) == [[0, 1, 2], [4, 5]]


def test_a_chain_is_divided_into_mutually_similar_sets():
    angles = np.radians([0, 25, 50, 75])
    x = np.zeros((4, 64))
    x[:, 0], x[:, 1] = np.cos(angles), np.sin(angles)
    found = clusters.local_clusters(x.astype("float32"), 0.8)
    for members in found:
        assert (x[members] @ x[members].T >= 0.8 - 1e-6).all()
    assert len({int(i) for m in found for i in m}) == sum(map(len, found))


def test_usable_vectors(spark):
    found = cells.usable_vectors(frame(spark, [[3.0] + [0.0] * 63, *unusable()]).withColumn("id", F.col("id")), "id", "vec").collect()
    assert [(r.id, r.v[0]) for r in found] == [(1, 1.0)]

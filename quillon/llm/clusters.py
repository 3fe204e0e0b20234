"""Problem 4: clusters of mutually similar vectors, by density clustering in overlapping cells.

The vectors are reduced to their main directions, and a partition tree over the reduced vectors (fitted on a
bounded sample) gives the cells; a vector belongs to its nearest cell and to the next ones within the margin.
In each cell vectors are linked by density on the full vectors: vectors with ``points`` vectors or more (themselves
counted) of similarity ``LEAST`` are core points, and core points within reach are of one set.  A cell of many rows is cut
into parts by a hash; each part is linked by itself, and two parts meet in one task, where sets with a similar pair are
linked, so that no task holds more than two parts.  Sets that share a core point, or are linked so, are merged by Borůvka
contraction over links that are never gathered.  Nothing is divided before sets are whole, so parts do not show
in the result, nor do cells, which are more in larger tables, as long as chains of similar vectors share cells; a pair that
shares none is not seen.  With more than two ``points``, neighbours are counted within two parts only.

A merged set whose members all lie within half the angle of ``LEAST`` around its centre is a set of mutually similar
vectors; all others are compared pair by pair, in blocks.  A set that fails is divided, whatever its size, by one rule
and as a whole: its neighbours are counted in the blocks, and one task, which holds its vectors, takes sets from it.
Members closest to the sum of their cluster are its medoids: for unit vectors that order is the order of total
similarity, so no pairs are compared for it.

Equal vectors are indexed once, by their smallest id, and get the cluster of that id: a set of copies of any
size costs one row of the index.

Defined cases: unusable vectors belong to no cluster; rows with one id count once; clusters of fewer than
three members are not reported; empty tables give no rows; ties in typicality go to the smaller id; further
columns, the published ``community`` among them, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import vector_sums
from .cells import DIMENSIONS, as_rows, first_copies, nearest_cells, sample, split_cells, usable_vectors
from .common import checkpointed, join_hot, table, top_positions
from .forest import spanning_forest

LEAST, POINTS = 0.80, 2
REDUCED = 40
RESIDENTS = 1000
PROBES, MARGIN = 5, 0.12
BLOCK = 512
#: Rows of one part of a cell and of one block of a merged set, about.
PART_ROWS = 8192


def principal(points, dimensions: int = REDUCED):
    """Directions (64, dimensions) of the largest second moments of the sample."""
    import numpy as np

    if not len(points):
        return np.eye(DIMENSIONS, dimensions, dtype="float32")
    _, directions = np.linalg.eigh(points.T.astype("float64") @ points)
    return np.ascontiguousarray(directions[:, ::-1][:, :dimensions]).astype("float32")


def reduced(points, directions):
    import numpy as np

    low = points @ directions
    return low / np.maximum(np.linalg.norm(low, axis=1), 1e-9)[:, None]


def _degrees(x, others, least: float):
    import numpy as np

    return np.concatenate([(x[i : i + BLOCK] @ others.T >= least).sum(axis=1) for i in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0, int)


def reached(x, least: float, points: int = POINTS):
    """Lists of positions of the sets of two or more among the unit vectors ``x`` that core points within reach join, and
    whether the first of each reaches all others."""
    import numpy as np

    core = _degrees(x, x, least) >= points if points > 2 else np.ones(len(x), bool)
    taken = np.zeros(len(x), bool)
    waiting = np.flatnonzero(core)  # clusters start at core points; the others are taken by them
    found = []
    while len(waiting):
        # the neighbours of a block of seeds are looked up together; a cluster taken meanwhile is skipped
        seeds, free = waiting[:BLOCK], np.flatnonzero(~taken)
        near = x[seeds] @ x[free].T >= least
        for i, seed in enumerate(seeds):
            if taken[seed]:
                continue
            members = free[near[i]]
            members = members[~taken[members]]
            taken[seed] = True
            taken[members] = True
            if len(members) < 2:
                continue
            edge, whole, reach = members[(members != seed) & core[members]], [members], True
            while len(edge):
                rest = np.flatnonzero(~taken)
                fresh = [rest[:0]]
                for start in range(0, len(edge), BLOCK):
                    fresh.append(rest[(x[edge[start : start + BLOCK]] @ x[rest].T >= least).any(axis=0)])
                edge = np.unique(np.concatenate(fresh))
                taken[edge] = True
                if len(edge):
                    whole.append(edge)
                    edge, reach = edge[core[edge]], False
            found.append((np.concatenate(whole), reach))
        waiting = waiting[~taken[waiting]]
    return found


def local_clusters(x, least: float, points: int = POINTS):
    """Lists of positions of the clusters of two or more among the unit vectors ``x``, all pairs of each similar."""
    found = []
    for members, reach in reached(x, least, points):
        found += [members] if reach and all_similar(x[members], least) else _divide(x, members, least)
    return found


def around(x, least: float) -> bool:
    """Whether all vectors lie within half the angle of ``least`` around their centre, so that any two are similar."""
    import numpy as np

    centre = x.astype("float64").sum(axis=0)
    return bool((x @ (centre / max(np.linalg.norm(centre), 1e-9))).min() >= half_angle(least))


def half_angle(least: float) -> float:
    """The cosine of half the angle whose cosine is ``least``, and a little more for rounding."""
    return math.sqrt((1 + least) / 2) + 1e-6


def all_similar(x, least: float) -> bool:
    return around(x, least) or all(bool((x[i : i + BLOCK] @ x.T >= least).all()) for i in range(0, len(x), BLOCK))


def _divide(x, members, least: float, degree=None):
    """Sets of mutually similar vectors: each grown greedily from the member with most neighbours left.

    ``degree`` are the numbers of neighbours among the members, each its own, where they are known.
    """
    import numpy as np

    y = x[members]
    degree = (_degrees(y, y, least) if degree is None else degree).copy()
    sets, alive = [], np.ones(len(y), bool)
    while len(y) and degree.max() > 1:
        seed = int(degree.argmax())
        score = (y @ y[seed]).astype("float64")
        left = np.flatnonzero((score >= least) & alive)
        left = left[left != seed]
        own, z, score = [np.array([seed])], y[left], score[left]
        open_ = np.ones(len(left), bool)
        asked = len(left) + 1
        while open_.any():
            if open_.sum() * 2 < asked:  # ever smaller: copied, and looked at whether all that are left are similar
                left, z, score, open_ = left[open_], z[open_], score[open_], open_[open_]
                asked = len(left)
            if len(left) == asked and open_.all() and around(z, least):
                own.append(left)
                break
            nearest = int(np.where(open_, score, -np.inf).argmax())
            own.append(left[[nearest]])
            close = z @ z[nearest]
            score += close
            open_ &= close >= least
            open_[nearest] = False
        own = np.concatenate(own)
        if len(own) > 1:
            sets.append(members[own])
        alive[own] = False
        for start in range(0, len(own), BLOCK):
            degree = degree - (y[own[start : start + BLOCK]] @ y.T >= least).sum(axis=0)
        degree[~alive] = 0
        if alive.sum() * 2 < len(y):
            y, members, degree, alive = y[alive], members[alive], degree[alive], alive[alive]
    return sets


def _model(df: DataFrame, vectors: DataFrame):
    """Directions, cell centres and the number of parts of each cell, fitted on the bounded sample."""
    import numpy as np

    rows = df.count()
    points = sample(vectors, rows)
    directions = principal(points)
    low = reduced(points, directions) if len(points) else np.eye(1, REDUCED, dtype="float32")
    centres = split_cells(low, max(8, math.ceil(len(low) * RESIDENTS / max(rows, 1))))
    inside = np.zeros(len(centres))
    for start in range(0, len(low), BLOCK):
        inside += np.bincount(nearest_cells(low[start : start + BLOCK], centres, PROBES, MARGIN)[1], minlength=len(centres))
    parts = np.maximum(1, np.ceil(inside * rows / max(len(low), 1) / PART_ROWS)).astype("int64")
    return directions, centres, parts


def _part_of(ids, parts):
    """The part of its cell that a row is in, by a hash of its id."""
    import numpy as np

    return (((ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % parts.astype("uint64")).astype("int64")


def _visits(model):
    """Function for mapInArrow: rows (id, v) to (cell, i, j, part, id, v), once for each pair of parts that its part is in."""

    def visit(batches):
        import numpy as np
        import pyarrow as pa

        directions, centres, parts = model.value
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            row, cell, _ = nearest_cells(reduced(as_rows(pa.chunked_array([batch.column(1)])), directions), centres, PROBES, MARGIN)
            times = parts[cell]
            part = _part_of(batch.column(0).to_numpy()[row], times)
            again = np.repeat(np.arange(len(row)), times)
            other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            own = part[again]
            took = batch.take(pa.array(row[again]))
            low, high = np.minimum(own, other), np.maximum(own, other)
            columns = [pa.array(cell[again].astype("int32")), pa.array(low), pa.array(high), pa.array(own), *took.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "i", "j", "part", "id", "v"])

    return visit


def _links(least: float, points: int):
    """Function for applyInArrow: the links (a, b) of one part of a cell, or between the sets of two parts."""

    def dense(rows):
        import numpy as np
        import pyarrow as pa

        ids, part, x = rows.column("id").to_numpy(), rows.column("part").to_numpy(), as_rows(rows.column("v"))
        order = np.argsort(ids, kind="stable")
        ids, part, x = ids[order], part[order], x[order]
        sides = [np.flatnonzero(part == p) for p in np.unique(part)]
        a, b = [ids[:0]], [ids[:0]]
        if rows.column("i")[0].as_py() == rows.column("j")[0].as_py():
            for members, _ in reached(x, least, points):
                own = ids[members]
                a.append(own[own != own.min()])
                b.append(np.full(len(own) - 1, own.min()))
        elif len(sides) == 2:
            head = np.arange(len(x))  # the first of its set of its part, which the part itself links
            for side in sides:
                for members, _ in reached(x[side], least, points):
                    head[side[members]] = side[members].min()
            left, right = sides
            core = np.ones(len(x), bool)
            if points > 2:
                for side, other in ((left, right), (right, left)):
                    core[side] = _degrees(x[side], x[side], least) + _degrees(x[side], x[other], least) >= points
            for start in range(0, len(left), BLOCK):
                own = left[start : start + BLOCK]
                near = (x[own] @ x[right].T >= least) & (core[own][:, None] | core[right])
                p, q = np.nonzero(near)
                met = np.unique(head[own[p]] * len(x) + head[right[q]])
                a.append(ids[met // len(x)])
                b.append(ids[met % len(x)])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return dense


def checked(labelled: DataFrame, least: float, rows: int) -> DataFrame:
    """(id, cluster_id) of merged sets ``labelled(id, v, root)``, those that are not mutually similar divided as a whole."""
    total = vector_sums(labelled, ["root"], "v")
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    inner = F.aggregate(F.zip_with("v", "s", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    centred = join_hot(labelled.select("id", "v", "root"), total, ["root"], rows=rows).withColumn("near", inner / F.greatest(length, F.lit(1e-9)))
    wide = centred.groupBy("root").agg(F.min("near").alias("near"), F.first("n").alias("n")).filter(F.col("near") < half_angle(least)).select("root", "n")
    wide = checkpointed(wide)
    if wide.isEmpty():
        return labelled.select("id", F.col("root").alias("cluster_id"))
    doubtful = checkpointed(labelled.join(wide, "root").select("id", "v", "root", "n"))
    blocks = F.ceil(F.col("n") / PART_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    met = doubtful.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "v")

    def counted(rows):
        import numpy as np
        import pyarrow as pa

        ids, x, block = rows.column("id").to_numpy(), as_rows(rows.column("v")), rows.column("block").to_numpy()
        root, i, j = (rows.column(c)[0].as_py() for c in ("root", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = np.zeros(len(x), "int64")
        for s in range(0, len(left), BLOCK):
            close = x[left[s : s + BLOCK]] @ x[right].T >= least
            near[left[s : s + BLOCK]] += close.sum(axis=1)
            if i != j:
                near[right] += close.sum(axis=0)
        return pa.table({"root": pa.array(np.full(len(ids), root)), "id": pa.array(ids), "near": pa.array(near)})

    counts = met.groupBy("root", "i", "j").applyInArrow(counted, "root bigint, id bigint, near bigint").groupBy("root", "id").agg(F.sum("near").alias("near"))
    counts = checkpointed(counts)
    broken = counts.groupBy("root").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).filter("near < n").select("root")

    def divided(rows):
        import numpy as np
        import pyarrow as pa

        ids, x, near = rows.column("id").to_numpy(), as_rows(rows.column("v")), rows.column("near").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, near = ids[order], x[order], near[order]
        label = ids.copy()
        for members in _divide(x, np.arange(len(ids)), least, near):
            label[members] = ids[members].min()
        return pa.table({"id": pa.array(ids), "label": pa.array(label)})

    again = doubtful.join(broken, "root", "left_semi").select("id", "v", "root").join(counts.select("id", "near"), "id")
    again = again.groupBy("root").applyInArrow(divided, "id bigint, label bigint")
    return labelled.select("id", "root").join(again, "id", "left").select("id", F.coalesce("label", "root").alias("cluster_id"))


def cluster(df: DataFrame, key: str, vector: str, least: float = LEAST, smallest: int = 3, points: int = POINTS) -> DataFrame:
    """(id, cluster_id, size, h1, h2) of the members of clusters of ``smallest`` or more."""
    vectors = usable_vectors(df, key, vector)
    model = df.sparkSession.sparkContext.broadcast(_model(df, vectors))
    members = checkpointed(vectors.select("id", "h1", "h2").dropDuplicates(["id"]))
    rows = members.count()
    first = checkpointed(first_copies(vectors, 1).select("id", "v", "h1", "h2"))
    visits = first.select("id", "v").mapInArrow(_visits(model), "cell int, i bigint, j bigint, part bigint, id bigint, v array<float>")
    links = visits.groupBy("cell", "i", "j").applyInArrow(_links(least, points), "a bigint, b bigint")
    labels, _ = spanning_forest(links)
    labelled = checkpointed(first.join(labels.withColumnRenamed("v", "id"), "id").select("id", "v", "root"))
    good = checked(labelled, least, rows)
    heads = first.select("id", "h1", "h2").join(good, "id", "left").select("h1", "h2", F.coalesce("cluster_id", "id").alias("cluster_id"))
    whole = join_hot(members, heads, ["h1", "h2"], rows=rows)
    sizes = whole.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= smallest)
    return join_hot(whole, sizes, ["cluster_id"], rows=rows).select("id", "cluster_id", "size", "h1", "h2")


def described(df: DataFrame, key: str, vector: str, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical_ids, medoid_similarity): each cluster with its most typical members."""
    members = checkpointed(cluster(df, key, vector).select("id", "cluster_id", "size"))
    rows = members.count()
    vectors = usable_vectors(df, key, vector).select("id", "v").dropDuplicates(["id"]).join(members, "id")
    totals = vector_sums(vectors, ["cluster_id"], "v").select("cluster_id", F.col("s").alias("total"))
    pairs = F.zip_with("v", "total", lambda a, b: a.cast("double") * b)
    near = F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)
    mean = F.round((near - 1) / (F.col("size") - 1), 6)
    scored = join_hot(vectors, totals, ["cluster_id"], rows=rows).select("cluster_id", "id", "size", mean.alias("mean_similarity"))
    top = top_positions(scored, "cluster_id", [F.col("mean_similarity").desc(), F.col("id").asc()], typical)
    return top.groupBy("cluster_id").agg(
        F.max("size").alias("size"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda m: m["id"]).alias("typical_ids"),
        F.max("mean_similarity").alias("medoid_similarity"),
    )


TABLES = (("lens_lesion", "lens_id", "feature"), ("sgp_node", "node_id", "weight"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [cluster(table(spark, sf_dir, t), key, v).select(F.lit(t).alias("tbl"), F.col("id").alias("item_id"), "cluster_id") for t, key, v in TABLES]
    return parts[0].unionByName(parts[1])


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [described(table(spark, sf_dir, t), key, v).withColumn("tbl", F.lit(t)) for t, key, v in TABLES]
    return parts[0].unionByName(parts[1])


_USABLE = """
WITH all_rows AS (SELECT DISTINCT ON (tbl, id) * FROM (SELECT 'lens_lesion' AS tbl, lens_id AS id, feature AS v FROM lens_lesion UNION ALL SELECT 'sgp_node', node_id, weight FROM sgp_node)),
doubles AS (SELECT tbl, id, list_transform(v, lambda x: x::DOUBLE) AS v FROM all_rows WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT tbl, id, (list_transform(v, lambda x: x / n))::DOUBLE[64] AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM doubles) WHERE n > 0),
near AS (SELECT a.tbl, a.id AS a, b.id AS b FROM u a JOIN u b ON a.tbl = b.tbl AND array_inner_product(a.v, b.v) >= 0.8),
found AS (SELECT tbl, a AS item_id, min(b) AS cluster_id, count(*) AS size, sum(b) AS same FROM near GROUP BY tbl, a)
"""
#: Any two members of a cluster have the same partners, so the smallest partner names it, and three partners make it.
ORACLE = {
    "p4_found": _USABLE + "SELECT tbl, item_id, cluster_id FROM found WHERE size >= 3",
    "p4_clusters": _USABLE + """, single AS (SELECT tbl, id, (list_transform(v, lambda x: x::FLOAT::DOUBLE))::DOUBLE[64] AS v FROM u),
c AS (SELECT f.tbl, cluster_id, item_id, size, v FROM found f JOIN single s ON f.tbl = s.tbl AND f.item_id = s.id WHERE size >= 3),
m AS (SELECT a.tbl, a.cluster_id, a.item_id, a.size, round((sum(array_inner_product(a.v, b.v)) - 1) / (a.size - 1), 6) AS mean FROM c a JOIN c b ON a.tbl = b.tbl AND a.cluster_id = b.cluster_id GROUP BY a.tbl, a.cluster_id, a.item_id, a.size)
SELECT tbl, cluster_id, any_value(size) AS size, (list(item_id ORDER BY mean DESC, item_id))[:3] AS typical_ids, max(mean) AS medoid_similarity FROM m GROUP BY tbl, cluster_id""",
}
QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters}

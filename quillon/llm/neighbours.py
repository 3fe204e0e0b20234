"""Problem 1: the most similar vectors of every vector, with score-aware four-bit codes.

A partition tree is fitted on a bounded sample; every vector lives in the cell of its nearest centre and visits
all others that are almost as near, however many.  Where the table has many more rows than the tree's leaves can
hold, every leaf is cut again by the same residual centres, so that the number of cells grows with the table.
A group that splits would not separate stays one cell, and cells of many rows are scanned in salted blocks of
residents and visitors.  In a cell each resident is stored as 32 codes of four bits
of its residual to the centre.  Codes and codebook minimise the anisotropic loss: of the residual error, the
part parallel to the vector weighs ``eta`` times the rest, as it is that part which changes large inner
products.  Visitors score all residents by table scans (16 entries per code, all queries of a block side by
side), the best go to an exact comparison, as do all others whose codes cannot rule them out, and the lists of all
cells are merged by similarity and id.

Nothing is dropped: every usable vector is indexed or a copy, and asks.  Equal vectors are indexed by their ``k + 1``
smallest ids: by the tie rule the first ``k`` are the neighbours of all further ones, which get that list by a join.
Sizes that are broadcast (centres, residual centres, codebook) are bounded by constants below.

Defined cases: vectors that are null, wrongly sized, not finite or zero have no neighbours; rows with one id
count once; ties go to the smaller id; similarities are rounded to six places before they are ranked; empty
tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cells import DIMENSIONS, FIT_ROWS, as_rows, first_copies, sample, split_cells, usable_vectors
from .common import join_hot, table

SUBSPACES, CODES = 32, 16
WIDTH = DIMENSIONS // SUBSPACES
#: Similarity above which the loss is to rank well; eta follows from it.
THRESHOLD = 0.8
ETA = (DIMENSIONS - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)
RESIDENTS = 1000
#: A visit is made where a centre is less near than the nearest by at most this.
MARGIN = 0.06
#: Residents and visitors of a cell that one task scans, about.
RESIDENT_BLOCK, ASKER_BLOCK = 8192, 32_768
RERANKED = 48
QUERY_BLOCK = 256
#: The margin where neighbours of any similarity are asked for: those of noise lie in more cells.
WIDE_MARGIN = 0.4
#: Cells of the second level in one of the first, at most, and of both levels together.
SUB_MOST, CELLS_MOST = 256, 1 << 20
#: Rows whose visits are looked for together, and visits sent together.
VISIT_ROWS, VISIT_SENT = 2048, 16_384


def encode(vectors, residuals, codebook, sweeps: int = 2):
    """Codes of the anisotropic loss, by coordinate descent over the subspaces from the plain nearest codes."""
    import numpy as np

    n = len(vectors)
    x, r = vectors.reshape(n, SUBSPACES, WIDTH), residuals.reshape(n, SUBSPACES, WIDTH)
    norms = (codebook**2).sum(axis=2)
    codes = np.empty((n, SUBSPACES), "int64")
    for m in range(SUBSPACES):
        codes[:, m] = (norms[m] - 2 * r[:, m] @ codebook[m].T).argmin(axis=1)
    chosen = codebook[np.arange(SUBSPACES), codes]
    along = ((r - chosen) * x).sum(axis=2)  # parallel error by subspace
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for m in range(SUBSPACES):
            error = norms[m] - 2 * r[:, m] @ codebook[m].T
            parallel = (r[:, m] * x[:, m]).sum(axis=1)[:, None] - x[:, m] @ codebook[m].T
            rest = total - along[:, m]
            best = (error + (ETA - 1) * (rest[:, None] + parallel) ** 2).argmin(axis=1)
            codes[:, m] = best
            along[:, m] = parallel[np.arange(n), best]
            total = rest + along[:, m]
    return codes.astype("uint8")


def fit_codebook(vectors, residuals, rounds: int = 6, seed: int = 3):
    """Codebook (SUBSPACES, CODES, WIDTH) of the anisotropic loss: codes, then the least squares of each codeword."""
    import numpy as np

    n = len(vectors)
    rng = np.random.default_rng(seed)
    x, r = vectors.reshape(n, SUBSPACES, WIDTH), residuals.reshape(n, SUBSPACES, WIDTH)
    book = np.ascontiguousarray(r[rng.choice(n, CODES, replace=n < CODES)].transpose(1, 0, 2)).astype("float32")
    for _ in range(rounds):
        codes = encode(vectors, residuals, book, sweeps=1).astype("int64")
        along = ((r - book[np.arange(SUBSPACES), codes]) * x).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(SUBSPACES):
            xm, rm, c = x[:, m], r[:, m], codes[:, m]
            target = total - along[:, m] + (xm * rm).sum(axis=1)
            left = np.zeros((CODES, WIDTH, WIDTH))
            right = np.zeros((CODES, WIDTH))
            count = np.bincount(c, minlength=CODES)
            for i in range(WIDTH):
                right[:, i] = np.bincount(c, rm[:, i] + (ETA - 1) * xm[:, i] * target, minlength=CODES)
                for j in range(WIDTH):
                    left[:, i, j] = np.bincount(c, (ETA - 1) * xm[:, i] * xm[:, j] + (i == j), minlength=CODES)
            used = count > 0
            left[~used] = np.eye(WIDTH)
            solved = np.linalg.solve(left + 1e-6 * np.eye(WIDTH), right[:, :, None])[:, :, 0]
            book[m][used] = solved[used].astype("float32")
    return book


def reach(least: float) -> float:
    """The largest distance of unit vectors of similarity ``least``."""
    return math.sqrt(max(0.0, 2 - 2 * least))


class Cells:
    """Cells of one or two levels: centres of the tree, and in each of them the same residual centres ``sub``.

    What is kept is bounded by constants, while the number of cells is the product: it grows with the table to
    CELLS_MOST.  A cell's number is that of its tree cell times the number of residual centres, plus that of its own.
    """

    def __init__(self, centres, sub):
        import numpy as np

        self.centres, self.sub, self.width = centres, sub, len(sub)
        self.cross = centres @ sub.T
        lengths = (sub**2).sum(axis=1)[None, :] + 2 * self.cross + (centres**2).sum(axis=1)[:, None]
        self.norm = np.sqrt(np.maximum(lengths, 1e-12)).astype("float32")
        self.gram = sub @ sub.T

    def __len__(self):
        return len(self.centres) * self.width

    def centre(self, cell: int):
        top, low = divmod(int(cell), self.width)
        return (self.centres[top] + self.sub[low]) / self.norm[top, low]

    def visits(self, points, most_apart: float, margin: float = MARGIN):
        """(row, cell, home): for each point its nearest cell and all within ``margin`` of it.

        A vector and its partner, ``most_apart`` away at most, differ by at most that times the distance of two centres
        in how much nearer one of them is, so cells beyond that hold no partner and are not visited.  This holds on both
        levels, as a vector's home is the nearest of the second level in the nearest of the first.
        """
        import numpy as np

        row, cell, home = visited_cells(points, self.centres, most_apart, margin)
        if self.width == 1:
            return row, cell, home
        found = ([], [], [])
        for start in range(0, len(row), VISIT_ROWS):
            r, c, h = (x[start : start + VISIT_ROWS] for x in (row, cell, home))
            norm = self.norm[c]
            close = ((points[r] * self.centres[c]).sum(axis=1)[:, None] + points[r] @ self.sub.T) / norm
            best = close.argmax(axis=1)
            at = np.arange(len(r))
            inner = 1 + self.cross[c, best][:, None] + self.cross[c] + self.gram[best]
            between = np.sqrt(np.maximum(2 - 2 * inner / (norm[at, best][:, None] * norm), 0))
            kept = close[at, best][:, None] - close <= np.minimum(margin, most_apart * between + 1e-5)
            kept[at, best] = True
            i, low = np.nonzero(kept)
            for out, x in zip(found, (r[i], c[i] * self.width + low, h[i] & (low == best[i]))):
                out.append(x)
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in found)

    def homes(self, points):
        row, cell, home = self.visits(points, 0.0, 0.0)
        out = cell[home].copy()
        out[row[home]] = cell[home]
        return out


def visited_cells(points, centres, most_apart: float, margin: float = MARGIN):
    """As ``Cells.visits`` on one level."""
    import numpy as np

    close = points @ centres.T
    best = close.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))[best]
    kept = close[np.arange(len(points)), best][:, None] - close <= np.minimum(margin, most_apart * between + 1e-6)
    kept[np.arange(len(points)), best] = True
    row, cell = np.nonzero(kept)
    return row, cell, cell == best[row]


def residual_centres(points, centres, rows: int, wanted: int | None = None, seed: int = 5):
    """Centres of the second level, by k-means of the sample's residuals; one at zero where a level is enough."""
    import numpy as np

    need = rows / (len(centres) * RESIDENTS)
    if wanted is None:
        wanted = 1 if need <= 4 else int(min(SUB_MOST, CELLS_MOST // len(centres), 2 ** math.ceil(math.log2(need))))
    if wanted <= 1 or len(points) < 4 * wanted:
        return np.zeros((1, DIMENSIONS), "float32")
    rest = points - centres[(points @ centres.T).argmax(axis=1)]
    book = rest[np.random.default_rng(seed).choice(len(rest), wanted, replace=False)].copy()
    for _ in range(8):
        near = ((book**2).sum(axis=1)[None, :] - 2 * rest @ book.T).argmin(axis=1)
        count = np.bincount(near, minlength=wanted)
        sums = np.stack([np.bincount(near, rest[:, d], minlength=wanted) for d in range(DIMENSIONS)], axis=1)
        book[count > 0] = (sums[count > 0] / count[count > 0][:, None]).astype("float32")
    return book


def separable_cells(points, largest: int, most_apart: float, seed: int = 7):
    """Centres of a tree of two-means splits; a leaf of which most points would visit both sides is not split."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        pair = split_cells(points[own], max(largest, len(own) // 2, 4), int(rng.integers(1 << 30))) if len(own) > max(largest, 4) else []
        if len(pair) >= 2:
            near = (points[own] @ pair.T).argmax(axis=1)
            row, _, _ = visited_cells(points[own], pair, most_apart)
            parts = [own[near == c] for c in range(len(pair))]
            if len(row) - len(own) <= 0.5 * len(own) * (len(pair) - 1) and max(map(len, parts)) < len(own):
                open_ += [part for part in parts if len(part)]
                continue
        centres.append(points[own].mean(axis=0))
    found = np.array(centres, "float32")
    return found / np.maximum(np.linalg.norm(found, axis=1), 1e-9)[:, None]


def largest_leaf(points, rows: int) -> int:
    return max(8, math.ceil(len(points) * RESIDENTS / max(rows, 1)))


def pair_model(points, rows: int, least: float, margin: float = MARGIN, wanted: int | None = None):
    """Model of an index: centres of both levels, the length of the residuals in each tree cell, the codebook, and in
    how many blocks of residents and of visitors each cell is scanned."""
    import numpy as np

    if not len(points):
        points = np.eye(1, DIMENSIONS, dtype="float32")
    centres = separable_cells(points, largest_leaf(points, rows), reach(least))
    sub = residual_centres(points, centres, rows, wanted)
    cells = Cells(centres, sub)
    home = cells.homes(points)
    top = home // cells.width
    residuals = points - (centres[top] + sub[home % cells.width]) / cells.norm[top, home % cells.width][:, None]
    squared = (residuals**2).sum(axis=1)
    count = np.bincount(top, minlength=len(centres))
    overall = max(float(np.sqrt(squared.mean())), 1e-3)
    lengths = np.sqrt(np.bincount(top, squared, minlength=len(centres)) / np.maximum(count, 1))
    lengths = np.where((count >= 4) & (lengths > 1e-3), lengths, overall).astype("float32")
    book = fit_codebook(points, residuals / lengths[top][:, None])
    each, residents, askers = rows / len(points), np.zeros(len(cells)), np.zeros(len(cells))
    for start in range(0, len(points), VISIT_ROWS):
        _, cell, at_home = cells.visits(points[start : start + VISIT_ROWS], reach(least), margin)
        residents += np.bincount(cell[at_home], minlength=len(cells))
        askers += np.bincount(cell, minlength=len(cells))
    blocks = lambda n, size: np.maximum(1, np.ceil(n * each / size)).astype("int32")
    return {"centres": centres, "sub": sub, "lengths": lengths, "codebook": book, "blocks": np.stack([blocks(residents, RESIDENT_BLOCK), blocks(askers, ASKER_BLOCK)], axis=1)}


def placed_in_blocks(ids, cell, home, blocks):
    """(visit, part, home, asks): visits repeated so that in each cell every visitor meets every resident once."""
    import numpy as np

    mixed = (ids.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    r, a = blocks[cell, 0].astype("int64"), blocks[cell, 1].astype("int64")
    own_r, own_a = (mixed % r.astype("uint64")).astype("int64"), ((mixed >> np.uint64(7)) % a.astype("uint64")).astype("int64")
    repeated = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    visit, block = repeated(r)
    out = [(visit, block * a[visit] + own_a[visit], home[visit] & (block == own_r[visit]), np.ones(len(visit), bool))]
    visit, block = repeated(np.where(home, a, 0))
    rest = block != own_a[visit]  # elsewhere a resident only answers
    visit, block = visit[rest], block[rest]
    out.append((visit, own_r[visit] * a[visit] + block, np.ones(len(visit), bool), np.zeros(len(visit), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def entry_tables(queries, codebook):
    """(tables, low, step): entries of 11 bits for each query, their zero summed up and the value of one."""
    import numpy as np

    n = len(queries)
    tables = np.einsum("qmw,mkw->mkq", queries.reshape(n, SUBSPACES, WIDTH), codebook, optimize=True)
    low = tables.min(axis=1, keepdims=True)
    tables -= low
    top = np.maximum(tables.max(axis=(0, 1), keepdims=True), 1e-9)
    tables *= 2047.0 / top  # 32 entries of 11 bits fit 16 bits
    return tables.astype("uint16"), low.sum(axis=(0, 1)), top[0, 0] / 2047.0


def summed(tables, codes):
    import numpy as np

    scores = np.zeros((len(codes), tables.shape[2]), "uint16")
    for m in range(SUBSPACES):
        scores += tables[m][codes[:, m]]
    return scores


def table_scores(queries, codes, codebook):
    """(rows, queries) scores in integers that rank the rows of one cell for each query."""
    return summed(entry_tables(queries, codebook)[0], codes)


def _scan_cell(model, k: int, least: float):
    """Function for applyInArrow: the pairs (a, b, s) of a cell's visitors and their best residents."""

    def scan(rows):
        import numpy as np
        import pyarrow as pa

        ids, home = rows.column("id").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False)
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        x, cell = as_rows(rows.column("v")), rows.column("cell")[0].as_py()
        order = np.argsort(ids, kind="stable")  # lower ids first, whatever the order of arrival
        ids, home, asks, x = ids[order], home[order], asks[order], x[order]
        at = np.flatnonzero(home)
        residents, names = x[at], ids[at]
        values = model.value
        out = ([], [], [])
        if len(at):
            levels = Cells(values["centres"], values["sub"])
            centre, length = levels.centre(cell), values["lengths"][cell // levels.width]
            codes = encode(residents, (residents - centre) / length, values["codebook"])
            missed = residents - centre - length * values["codebook"][np.arange(SUBSPACES), codes].reshape(len(at), DIMENSIONS)
            along, off = (missed * residents).sum(axis=1), np.sqrt((missed**2).sum(axis=1))
            double = residents.astype("float64")
            kept = min(RERANKED, len(at))
            askers = np.flatnonzero(asks)
            for start in range(0, len(askers), QUERY_BLOCK):
                block = askers[start : start + QUERY_BLOCK]
                q = x[block]
                if kept < len(at):
                    tables, low, step = entry_tables(q, values["codebook"])
                    scores = np.ascontiguousarray(summed(tables, codes).T)
                    some = np.argpartition(scores, len(at) - kept, axis=1)[:, len(at) - kept :]
                    some.sort(axis=1)
                else:
                    some = np.broadcast_to(np.arange(kept), (len(q), kept))
                exact = np.round(np.einsum("qd,qrd->qr", q.astype("float64"), double[some]), 6)
                exact[names[some] == ids[block][:, None]] = -9
                best = np.argsort(-exact, axis=1, kind="stable")[:, : min(k, kept)]
                value = np.take_along_axis(exact, best, axis=1)
                row, place = np.nonzero(value >= max(least, -8))
                who, whom, how = row, some[row, best[row, place]], value[row, place]
                if kept < len(at):
                    # a resident of similarity ``floor`` or more has at most this one by its codes and what they miss
                    floor = np.maximum(value[:, -1], least) if kept >= k else np.full(len(q), least)
                    bound = scores * (length * step)[:, None].astype("float32")
                    bound += off * np.sqrt(np.maximum(2 - 2 * floor + 1e-5, 0))[:, None].astype("float32")
                    bound += along
                    bound += (q @ centre + length * (low + (SUBSPACES + 1) * step))[:, None]
                    possible = bound >= (floor - 1e-5)[:, None]
                    np.put_along_axis(possible, some, False, axis=1)
                    again = np.flatnonzero(possible.any(axis=1))
                    if len(again):
                        full = np.round(q[again].astype("float64") @ double.T, 6)
                        full[names == ids[block[again]][:, None]] = -9
                        most = min(k, len(at))
                        last = np.maximum(-np.partition(-full, most - 1, axis=1)[:, most - 1], max(least, -8))
                        row, found = np.nonzero(full >= last[:, None])
                        order = np.lexsort((found, -full[row, found], row))
                        row, found = row[order], found[order]
                        first = np.arange(len(row)) - np.searchsorted(row, row) < k
                        row, found = row[first], found[first]
                        rest = ~np.isin(who, again)
                        who, whom, how = (np.concatenate(p) for p in ((who[rest], again[row]), (whom[rest], found), (how[rest], full[row, found])))
                out[0].append(ids[block][who])
                out[1].append(names[whom])
                out[2].append(how)
        a, b, s = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"a": pa.array(a.astype("int64")), "b": pa.array(b.astype("int64")), "s": pa.array(s.astype("float64"))})

    return scan


def _indexed_pairs(vectors: DataFrame, rows: int, k: int, least: float, margin: float, every: int | None, sub_cells: int | None) -> DataFrame:
    """(a, b, s, place) for the indexed vectors that ask: all of them, or those whose id ``every`` divides."""
    model = vectors.sparkSession.sparkContext.broadcast(pair_model(sample(vectors, rows), rows, least, margin, sub_cells))

    def visit(batches):
        import numpy as np
        import pyarrow as pa

        cells, blocks = Cells(model.value["centres"], model.value["sub"]), model.value["blocks"]
        for batch in (b.slice(i, VISIT_ROWS) for b in batches for i in range(0, b.num_rows, VISIT_ROWS)):
            points, ids = as_rows(pa.chunked_array([batch.column(1)])), batch.column(0).to_numpy()
            row, cell, home = cells.visits(points, reach(least), margin)
            asker = np.ones(len(ids), bool) if every is None else ids % every == 0
            used = home | asker[row]
            row, cell, home = row[used], cell[used], home[used]
            visit, part, home, asks = placed_in_blocks(ids[row], cell, home, blocks)
            asks &= asker[row[visit]]
            used = home | asks
            visit, part, home, asks = visit[used], part[used], home[used], asks[used]
            for i in range(0, len(visit), VISIT_SENT):
                own = visit[i : i + VISIT_SENT]
                took = batch.take(pa.array(row[own]))
                columns = [pa.array(cell[own].astype("int32")), pa.array(part[i : i + VISIT_SENT]), took.column(0), pa.array(home[i : i + VISIT_SENT]), pa.array(asks[i : i + VISIT_SENT]), took.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "part", "id", "home", "asks", "v"])

    visits = first_copies(vectors, k + 1).select("id", "v").mapInArrow(visit, "cell int, part bigint, id bigint, home boolean, asks boolean, v array<float>")
    pairs = visits.groupBy("cell", "part").applyInArrow(_scan_cell(model, k, least), "a bigint, b bigint, s double")
    both = _both_ways(pairs)
    if every is not None:
        both = both.filter(F.pmod("a", F.lit(every)) == 0)
    once = both.groupBy("a", "b").agg(F.max("s").alias("s"))
    order = Window.partitionBy("a").orderBy(F.col("s").desc(), F.col("b").asc())
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def neighbour_pairs(df: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, margin: float | None = None, every: int | None = None, sub_cells: int | None = None) -> DataFrame:
    """(a, b, s, place): for each usable vector its ``k`` most similar ones of similarity ``least`` or more.

    With ``every`` only the rows whose id it divides ask, against all.  A pair that either side finds counts for both.
    """
    rows = df.count()
    vectors = usable_vectors(df, key, vector)
    margin = margin if margin is not None else MARGIN if least > 0.5 else WIDE_MARGIN
    found = _indexed_pairs(vectors, rows, k, least, margin, every, sub_cells)
    # copies beyond the k + 1 smallest ids of their set have the k smallest as neighbours
    asks = F.lit(True) if every is None else F.pmod("id", F.lit(every)) == 0
    index = first_copies(vectors.select("id", "h1", "h2"), k + 1)
    heads = index.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > k)
    heads = heads.select("h1", "h2", F.slice("ids", 1, k).alias("near"), F.element_at("ids", k + 1).alias("last"))
    later = join_hot(vectors.select("id", "h1", "h2").filter(asks), heads, ["h1", "h2"], rows=rows).filter(F.col("id") > F.col("last")).dropDuplicates(["id"])
    later = later.select(F.col("id").alias("a"), F.posexplode("near").alias("at", "b"))
    return found.unionByName(later.select("a", "b", F.lit(1.0).alias("s"), (F.col("at") + 1).alias("place")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, from one evaluation of ``pairs``."""
    ways = F.array(F.struct("a", "b", "s"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    return pairs.select(F.inline(ways))


def mutual_pairs(df: DataFrame, key: str, vector: str, least: float, k: int = 10, sub_cells: int | None = None) -> DataFrame:
    """(a, b, s), a < b: each is among the ``k`` most similar of the other, with similarity ``least`` or more.

    A copy beyond the ``k + 1`` smallest ids of its set is among nobody's first, so the indexed ones are enough.
    """
    listed = _indexed_pairs(usable_vectors(df, key, vector), df.count(), k, least, MARGIN, None, sub_cells)
    ends = listed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
    return ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("s")).filter("n = 2").drop("n")


def stated_neighbours(df: DataFrame, key: str, vector: str, every: int = 20, k: int = 10) -> DataFrame:
    """(id, neighbour_id, similarity, place) for the rows whose id ``every`` divides, against all rows in the cells they visit."""
    found = neighbour_pairs(df, key, vector, k, every=every)
    return found.select(F.col("a").alias("id"), F.col("b").alias("neighbour_id"), F.col("s").alias("similarity"), "place")


TABLES = (("lens_lesion", "lens_id", "feature"), ("frozen_feature", "feat_id", "pooled"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [mutual_pairs(table(spark, sf_dir, t), key, v, 0.985).select(F.lit(t).alias("tbl"), F.col("a").alias("a_id"), F.col("b").alias("b_id")) for t, key, v in TABLES]
    return parts[0].unionByName(parts[1])


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stated_neighbours(table(spark, sf_dir, t), key, v).withColumn("tbl", F.lit(t)) for t, key, v in TABLES]
    return parts[0].unionByName(parts[1])


_UNIT = """
WITH all_rows AS (SELECT DISTINCT ON (tbl, id) * FROM (SELECT 'lens_lesion' AS tbl, lens_id AS id, feature AS v FROM lens_lesion UNION ALL SELECT 'frozen_feature', feat_id, pooled FROM frozen_feature)),
doubles AS (SELECT tbl, id, list_transform(v, lambda x: x::DOUBLE) AS v FROM all_rows WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT tbl, id, (list_transform(v, lambda x: x / n))::DOUBLE[64] AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM doubles) WHERE n > 0)"""
#: A table that fits one cell, as those of the SQL check do, is searched whole, so the lists are exact there.
ORACLE = {
    "p1_neighbours": _UNIT + """,
f AS (SELECT tbl, id, (list_transform(v, lambda x: x::FLOAT::DOUBLE))::DOUBLE[64] AS v FROM u),
near AS (SELECT a.tbl, a.id, b.id AS neighbour_id, round(array_inner_product(a.v, b.v), 6) AS similarity FROM f a JOIN f b ON a.tbl = b.tbl AND a.id <> b.id WHERE a.id % 20 = 0)
SELECT tbl, id, neighbour_id, similarity, row_number() OVER (PARTITION BY tbl, id ORDER BY similarity DESC, neighbour_id) AS place FROM near QUALIFY place <= 10""",
    "p1_found": _UNIT + """,
near AS (SELECT a.tbl, a.id AS a, b.id AS b, round(array_inner_product(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.tbl = b.tbl AND a.id <> b.id AND array_inner_product(a.v, b.v) >= 0.9849),
top AS (SELECT *, row_number() OVER (PARTITION BY tbl, a ORDER BY s DESC, b) AS place FROM near WHERE s >= 0.985)
SELECT x.tbl, x.a AS a_id, x.b AS b_id FROM top x JOIN top y ON x.tbl = y.tbl AND x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.place <= 10 AND y.place <= 10""",
}
QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours}
assert FIT_ROWS * DIMENSIONS * 4 <= 16 << 20  # what is gathered to fit an index

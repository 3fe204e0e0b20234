"""Problem 5: train, validation and test splits that keep related records together.

Rows of a dataset are related through their image and through the column its ``group_column`` names.  Every value
links its rows to the smallest row id that has it, and Borůvka contraction (``forest``) gives the components with a
spanning forest over all of them, which is kept as a table.  Components are stratified by dataset, label and size
band (powers of two) and dealt to the splits systematically: in seeded order, the k-th component of a stratum
takes the point frac(start + k / golden ratio) of the cumulative proportions, so that each run of neighbours
is shared out in proportion.  A component larger than a split's whole share is not dealt to that split.

Defined cases: a missing or placeholder value joins nothing; a row without image and group stands alone; rows
of a dataset that ``dataset_config`` lacks are joined by image only and get a null split; rows with the same
row_id count once and rows without one are left out, as they cannot be named; values are compared by letters
and digits, ignoring case; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, join_hot, scratch, table, with_position
from .forest import spanning_forest, write_forest

# Ways of writing that a value is missing, by their letters and digits.
PLACEHOLDERS = ("", "na", "nan", "nil", "none", "null", "unknown", "unk", "missing", "notrecorded", "notavailable", "notapplicable", "undefined")
GOLDEN = 0.6180339887498949
#: A dimension table of at most so many rows is sent to every executor.
SMALL_DIMENSION = 10_000


def comparable(value: Column) -> Column:
    """Letters and digits of a value in lower case; null where it is missing or a placeholder."""
    plain = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    return F.when(~plain.isin(*PLACEHOLDERS), plain)


def _with_config(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Rows with the values their dataset names as group and label.  The configuration is sent whole if it is small."""
    named = config.select("dataset_id", F.col("group_column").alias("_gc"), F.col("label_column").alias("_lc"))
    named = _sent(named.dropDuplicates(["dataset_id"]))
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    own = rows.select("row_id", "dataset_id", "image_id", *[F.col(f"`{c}`").alias(f"text:{c}") for c in texts])
    both = own.join(named, "dataset_id", "left")
    pick = lambda which: F.coalesce(F.lit(None).cast("string"), *[F.when(F.col(which) == c, F.col(f"`text:{c}`")) for c in texts])
    return both.select("row_id", "dataset_id", comparable(F.col("image_id")).alias("ik"), comparable(pick("_gc")).alias("gk"), F.coalesce(comparable(pick("_lc")), F.lit("")).alias("label"))


def _sent(dimension: DataFrame) -> DataFrame:
    """A dimension table, marked for broadcast where its size allows."""
    return F.broadcast(dimension) if len(dimension.take(SMALL_DIMENSION + 1)) <= SMALL_DIMENSION else dimension


def _mark(kind: str, dataset: Column, value: Column) -> list[Column]:
    """Two 64-bit hashes of a value in its dataset, null where it is missing: fixed width, so that rows of it are
    combined by hash and not by sorting.  Of n values two are taken for one with a chance of n * n / 2**129."""
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(f"{kind}{i}"), dataset, value)).alias(f"{kind}{i}") for i in (0, 1)]


def related(rows: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, group_id, together) of every row, and the spanning forest of all that belong together."""
    flat = _with_config(rows.filter("row_id IS NOT NULL"), config)
    dataset = F.coalesce("dataset_id", F.lit("\x00"))
    marked = flat.select("row_id", *_mark("i", dataset, F.col("ik")), *_mark("g", dataset, F.col("gk")))
    marked = marked.groupBy("row_id").agg(*[F.first(c).alias(c) for c in ("i0", "i1", "g0", "g1")])
    marked = checkpointed(marked)
    keys = F.filter(F.array(F.struct(F.col("i0").alias("k0"), F.col("i1").alias("k1")), F.struct(F.col("g0").alias("k0"), F.col("g1").alias("k1"))), lambda k: k["k0"].isNotNull())
    keyed = marked.select("row_id", F.inline(keys))
    hubs = keyed.groupBy("k0", "k1").agg(F.min("row_id").alias("hub"), F.max("row_id").alias("last")).filter("hub < last").drop("last")
    edges = join_hot(keyed, hubs, ["k0", "k1"], rows=2 * marked.count()).select(F.col("row_id").alias("a"), F.col("hub").alias("b"))
    labels, forest = spanning_forest(edges)
    whole = marked.select("row_id").join(labels.withColumnRenamed("v", "row_id"), "row_id", "left")
    return whole.select("row_id", F.coalesce("root", "row_id").alias("group_id"), F.col("root").isNotNull().alias("together")), forest


def assign_splits(rows: DataFrame, config: DataFrame) -> DataFrame:
    """(row_id, dataset_id, group_id, split) of every row."""
    said = _with_config(rows.filter("row_id IS NOT NULL"), config).select("row_id", "dataset_id", "label").dropDuplicates(["row_id"])
    members = checkpointed(related(rows, config)[0].select("row_id", "group_id").join(said, "row_id"))
    by_label = members.groupBy("dataset_id", "group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = by_label.groupBy("dataset_id", "group_id").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("m"))
    totals = by_label.groupBy(F.col("dataset_id").alias("_d")).agg(F.sum("n").alias("total"))
    shares = config.select(F.col("dataset_id").alias("_c"), F.col("splits").alias("s")).dropDuplicates(["_c"])
    band = F.length(F.bin("size")) - 1
    parts = parts.join(_sent(totals), F.col("dataset_id").eqNullSafe(F.col("_d"))).join(_sent(shares), F.col("dataset_id") == F.col("_c"), "left")
    parts = parts.select("dataset_id", "group_id", "size", "s", "total", F.concat_ws("/", F.coalesce("dataset_id", F.lit("")), "m.label", band.cast("string")).alias("stratum"))
    seed = F.coalesce(F.col("s.seed").cast("string"), F.lit(""))
    parts = parts.withColumn("draw", F.md5(F.concat_ws(":", seed, F.col("group_id").cast("string"))))
    placed = with_position(parts, "stratum", [F.col("draw").asc()], "k")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", seed, "stratum")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    point = start + F.col("k") * F.lit(GOLDEN)
    fits = {p: F.when((F.col("size") <= F.col(f"s.{p}") * F.col("total")), F.col(f"s.{p}")).otherwise(0.0) for p in ("train", "val", "test")}
    placed = placed.select("group_id", "s", (point - F.floor(point)).alias("t"), *[w.alias(f"w_{p}") for p, w in fits.items()])
    t = F.col("t") * (F.col("w_train") + F.col("w_val") + F.col("w_test"))
    largest = F.when((F.col("s.train") >= F.col("s.val")) & (F.col("s.train") >= F.col("s.test")), "train").when(F.col("s.val") >= F.col("s.test"), "val").otherwise("test")
    none_fits = (F.col("w_train") + F.col("w_val") + F.col("w_test")) == 0
    split = F.when(F.col("s").isNull(), F.lit(None)).when(none_fits, largest).when(t < F.col("w_train"), "train").when(t < F.col("w_train") + F.col("w_val"), "val").when(F.col("w_test") > 0, "test").otherwise(largest)
    return join_hot(members, placed.select("group_id", split.alias("split")), ["group_id"]).select("row_id", "dataset_id", "group_id", "split")


def _tables(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "image_metadata"), table(spark, sf_dir, "dataset_config")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related(*_tables(spark, sf_dir))[0].filter("together").select("row_id", "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(*_tables(spark, sf_dir))


def p5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest as it is kept: written to a table of the shared folder and read from there."""
    return write_forest(related(*_tables(spark, sf_dir))[1], scratch(spark, "forest"))


def p5_forest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the kept forest spans: its edges, its vertices, and the components it has by itself."""
    forest = p5_forest(spark, sf_dir)
    labels = spanning_forest(forest)[0]
    edges = forest.agg(F.count(F.lit(1)).alias("edges"))
    return labels.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("root").alias("n_groups"), F.sum("root").alias("roots")).join(F.broadcast(edges))


_PLACEHOLDERS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
_KEY = "nullif(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"
_TEXTS = ("row_id", "dataset_id", "image_id", "lesion_id", "patient_id", "site_code", "dx", "dx_type", "age", "sex", "localization", "folder")
_NAMED = lambda which: "CASE " + which + " " + " ".join(f"WHEN '{c}' THEN m.{c}" for c in _TEXTS[1:]) + " END"
_GROUPS = f"""
WITH RECURSIVE flat AS (
  SELECT DISTINCT m.row_id, m.dataset_id, {_KEY.format("m.image_id")} AS ik, {_KEY.format(_NAMED("c.group_column"))} AS gk,
    {_KEY.format(_NAMED("c.label_column"))} AS lk, c.splits AS s
  FROM image_metadata m LEFT JOIN dataset_config c USING (dataset_id)
), keys AS (
  SELECT row_id, dataset_id || '/i/' || ik AS k FROM flat WHERE ik NOT IN ({_PLACEHOLDERS})
  UNION SELECT row_id, dataset_id || '/g/' || gk FROM flat WHERE gk NOT IN ({_PLACEHOLDERS})
), hubs AS (SELECT k, min(row_id) AS hub FROM keys GROUP BY k HAVING count(*) > 1),
links AS (SELECT row_id AS a, hub AS b FROM keys JOIN hubs USING (k) WHERE row_id <> hub),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, a FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a
), found AS (SELECT a AS row_id, min(b) AS group_id FROM reach GROUP BY a)
"""
ORACLE = {
    "p5_found": _GROUPS + "SELECT row_id, group_id FROM found",
    "p5_forest_spans": _GROUPS + "SELECT count(*) - count(DISTINCT group_id) AS edges, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, sum(group_id)::BIGINT AS roots FROM found",
    "p5_splits": _GROUPS + f"""
, members AS (SELECT f.row_id, f.dataset_id, coalesce(g.group_id, f.row_id) AS group_id, CASE WHEN lk IN ({_PLACEHOLDERS}) THEN '' ELSE coalesce(lk, '') END AS label, s FROM flat f LEFT JOIN found g USING (row_id)
), by_label AS (SELECT dataset_id, group_id, label, count(*) AS n, any_value(s) AS s FROM members GROUP BY ALL
), parts AS (SELECT dataset_id, group_id, sum(n)::BIGINT AS size, max_by(label, (n, label)) AS label, any_value(s) AS s FROM by_label GROUP BY ALL
), totals AS (SELECT dataset_id, sum(n)::BIGINT AS total FROM by_label GROUP BY ALL
), strata AS (SELECT p.*, total, coalesce(p.dataset_id, '') || '/' || label || '/' || (length(bin(size)) - 1) AS stratum, coalesce(s.seed::VARCHAR, '') AS seed
  FROM parts p JOIN totals t ON p.dataset_id IS NOT DISTINCT FROM t.dataset_id
), placed AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(seed || ':' || group_id)) AS k FROM strata
), points AS (SELECT *, ('0x' || substr(md5(seed || ':' || stratum), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE + k::DOUBLE * {GOLDEN}::DOUBLE AS point FROM placed
), weighed AS (SELECT *, point - floor(point) AS t, CASE WHEN size <= s.train * total THEN s.train ELSE 0 END AS a, CASE WHEN size <= s.val * total THEN s.val ELSE 0 END AS b,
  CASE WHEN size <= s.test * total THEN s.test ELSE 0 END AS c, CASE WHEN s.train >= s.val AND s.train >= s.test THEN 'train' WHEN s.val >= s.test THEN 'val' ELSE 'test' END AS largest FROM points
), dealt AS (SELECT group_id, CASE WHEN s IS NULL THEN NULL WHEN a + b + c = 0 THEN largest WHEN t * (a + b + c) < a THEN 'train' WHEN t * (a + b + c) < a + b THEN 'val' WHEN c > 0 THEN 'test' ELSE largest END AS split FROM weighed)
SELECT row_id, dataset_id, group_id, split FROM members JOIN dealt USING (group_id)""",
}
QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_forest": p5_forest, "p5_forest_spans": p5_forest_spans}

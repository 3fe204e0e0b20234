"""Readers and writers: each query writes whole tables in a published layout and reads them back by the library's readers."""

from pyspark.sql import functions as F

from ..operators.positions import scratch
from ..sources import sinks
from ..sources import tables as T
from ..session import load
from .registry import query

_STEM = "replace(s_name, '#', '-')"


def _pictures(spark, d, path):
    """One small file for every supplier, at a path made of its columns."""
    rows = load(spark, d, "supplier").join(F.broadcast(load(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    stem = F.translate("s_name", "#", "-")
    root = scratch(spark, "pictures")
    sinks.write_blobs(rows.select(path(stem).alias("path"), F.encode("s_name", "UTF-8").alias("content")), "path", "content", root)
    return root


def _stem(path="path"):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


@query(f"SELECT n_name AS class, {_STEM} AS stem FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def class_folders_read(spark, d):
    """Images written to a folder for each class, listed with their class; other files are passed over."""
    root = _pictures(spark, d, lambda stem: F.concat("n_name", F.lit("/"), stem, F.lit(".PNG")))
    sinks.write_blobs(load(spark, d, "nation").select(F.concat("n_name", F.lit("/notes.txt")).alias("p"), F.lit("x").alias("c")), "p", "c", root)
    return T.folder_per_class(spark, root).select("class", _stem().alias("stem"))


@query(f"SELECT {_STEM} AS stem FROM supplier")
def flat_folder_read(spark, d):
    root = _pictures(spark, d, lambda stem: F.concat(stem, F.lit(".jpg")))
    return T.single_folder(spark, root).select("stem")


@query(f"SELECT n_name AS class, {_STEM} AS stem, ['train', 'val', 'test'][1 + s_suppkey % 3] AS split FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def presplit_folders_read(spark, d):
    """Folders of splits under their usual names in any case."""
    names = F.array(F.lit("Training"), F.lit("valid"), F.lit("TEST"))
    root = _pictures(spark, d, lambda stem: F.concat_ws("/", F.get(names, (F.col("s_suppkey") % 3).cast("int")), F.col("n_name"), F.concat(stem, F.lit(".webp"))))
    return T.presplit_folders(spark, root).select("class", _stem().alias("stem"), "split")


@query(f"SELECT {_STEM} AS stem, n_name AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def image_index_read(spark, d):
    """Recursive index by stem: of two files of one name the first path wins."""
    root = _pictures(spark, d, lambda stem: F.concat(F.lit("a/"), "n_name", F.lit("/"), stem, F.lit(".png")))
    rows = load(spark, d, "supplier").select(F.concat(F.lit("b/later/"), F.translate("s_name", "#", "-"), F.lit(".png")).alias("p"), F.lit("x").alias("c"))
    sinks.write_blobs(rows, "p", "c", root)
    return T.image_index(T.folder_per_class(spark, root)).select("stem", F.element_at(F.split("path", "/"), -2).alias("class"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 1")
def annotation_list_read(spark, d):
    """A list of names with comments and blank lines, joined to its listing."""
    part, path = load(spark, d, "part"), scratch(spark, "list")
    line = F.concat_ws(" ", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), F.lit("1 2"))
    text = F.when(F.col("p_partkey") % 3 == 1, line).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), line)).otherwise("   ")
    part.select(text.alias("value")).write.text(path)
    listed = T.annotation_list(spark, path)
    return part.join(listed, F.concat(F.lit("part-"), F.col("p_partkey").cast("string")) == F.col("name"), "left_semi").select("p_partkey", "p_name")


@query("SELECT row_id::VARCHAR AS row_id, nullif(dataset_id, '') AS dataset_id, nullif(image_id, '') AS image_id, nullif(dx, '') AS dx, nullif(age, '') AS age FROM image_metadata")
def csv_read(spark, d):
    """A metadata table written as CSV and read as text, with the columns that are needed checked by name; an empty field is a missing one."""
    path = scratch(spark, "csv")
    sinks.STORAGE["csv"](load(spark, d, "image_metadata").select("row_id", "dataset_id", "image_id", "dx", "age", "localization"), path)
    return T.csv_rows(spark, path, ["row_id", "image_id", "dx"]).select("row_id", "dataset_id", "image_id", "dx", "age")


@query(f"SELECT s_suppkey, n_name AS folder FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 3")
def csv_resolved_read(spark, d):
    """Rows of a CSV resolved to the first of several folders that has their image; others are dropped."""
    rows = load(spark, d, "supplier").join(F.broadcast(load(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    root, path, stem = scratch(spark, "parts"), scratch(spark, "rows"), F.translate("s_name", "#", "-")
    file = lambda folder, when: rows.filter(when).select(F.concat(F.lit(folder), "n_name", F.lit("/"), stem, F.lit(".jpg")).alias("p"), F.lit("x").alias("c"))
    k = F.col("s_suppkey") % 4
    sinks.write_blobs(file("one/", k <= 1), "p", "c", root)
    sinks.write_blobs(file("two/", (k == 1) | (k == 2)), "p", "c", root)
    sinks.STORAGE["csv"](load(spark, d, "supplier").select("s_suppkey", stem.alias("image")), path)
    folders = [T.image_index(T.folder_per_class(spark, f"{root}/{name}")) for name in ("one", "two")]
    found = T.resolved(T.csv_rows(spark, path, ["image"]), "image", folders)
    parts = F.split("path", "/")
    right = F.element_at(parts, -3) == F.when(F.col("s_suppkey").cast("int") % 4 == 2, "two").otherwise("one")
    return found.filter(right).select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), F.element_at(parts, -2).alias("folder"))


_CLASSES = ["akiec", "bcc", "bkl", "df", "mel", "nv", "vasc"]


@query(f"""WITH p AS (SELECT DISTINCT ON (lens_id) lens_id, list_transform(probabilities, lambda x: CASE WHEN isfinite(x) THEN x ELSE 0 END) AS p FROM lens_lesion WHERE len(probabilities) = 7)
SELECT lens_id, {_CLASSES}[list_position(p, list_max(p))] AS label FROM p WHERE list_max(p) > 0""")
def one_hot_read(spark, d):
    """One column for each class, written as CSV: the class of the largest value, bad numbers as zero."""
    rows = load(spark, d, "lens_lesion").filter(F.size("probabilities") == 7).select("lens_id", "probabilities").dropDuplicates(["lens_id"])
    value = lambda i: F.get("probabilities", F.lit(i))
    fine = lambda i: F.when(~F.isnan(value(i)) & (F.abs(value(i)) < float("inf")), value(i).cast("string")).otherwise("bad")
    path = scratch(spark, "onehot")
    sinks.STORAGE["csv"](rows.select("lens_id", *[fine(i).alias(c) for i, c in enumerate(_CLASSES)]), path)
    return T.one_hot_labels(T.csv_rows(spark, path, ["lens_id"]), "lens_id", _CLASSES).select(F.col("lens_id").cast("bigint").alias("lens_id"), "label")


@query("""SELECT p_partkey AS id, p_name AS name, p_brand AS label, count(*) FILTER (l_quantity > 25) AS n_present, count(*) AS n_attributes
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""")
def attribute_files_read(spark, d):
    """Indexed name and label files and long attribute lines, joined by id."""
    part, names, labels, marks = load(spark, d, "part"), scratch(spark, "names"), scratch(spark, "labels"), scratch(spark, "marks")
    key = F.col("p_partkey").cast("string")
    part.select(F.concat_ws(" ", key, "p_name").alias("value")).write.text(names)
    part.select(F.concat_ws(" ", key, "p_brand").alias("value")).write.text(labels)
    line = load(spark, d, "lineitem").select(F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_quantity") > 25).cast("int").cast("string"), F.lit("3 0.5")).alias("value"))
    line.unionByName(part.limit(1).select(F.lit("7 short").alias("value"))).write.text(marks)  # a line of too few fields
    present = T.attribute_rows(spark, marks).groupBy(F.col("image").alias("id")).agg(F.sum("present").alias("n_present"), F.count(F.lit(1)).alias("n_attributes"))
    named = T.indexed_lines(spark, names).select("id", F.col("value").alias("name")).join(T.indexed_lines(spark, labels).select("id", F.col("value").alias("label")), "id")
    return named.join(present, "id").select("id", "name", "label", "n_present", "n_attributes")


@query("SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS first, round(sum(embedding[64]::DOUBLE), 6) AS last FROM embeddings GROUP BY label")
def number_matrix_read(spark, d):
    """A matrix written as lines of numbers."""
    path = scratch(spark, "matrix")
    texts = F.concat(F.array(F.col("label").cast("string")), F.transform("embedding", lambda x: x.cast("double").cast("string")))
    load(spark, d, "embeddings").select(F.array_join(texts, "  ").alias("value")).write.text(path)
    v = T.number_matrix(spark, path)
    return v.groupBy(F.get("values", F.lit(0)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("values", F.lit(1))), 6).alias("first"), F.round(F.sum(F.get("values", F.lit(64))), 6).alias("last"))


@query("""SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_no, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings""")
def raw_arrays_read(spark, d):
    """The vectors of each label as one C-order float32 asset, decoded row by row."""
    root = scratch(spark, "arrays")
    packed = sinks.packed_arrays(load(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", "float32")
    sinks.write_blobs(packed.select(F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit(".bin")).alias("p"), "content"), "p", "content", root)
    label = F.regexp_extract("path", r"label_(\d+)\.bin$", 1).cast("int")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return T.raw_arrays(spark, root, "float32", 64).select(label.alias("label"), F.col("row").alias("row_no"), F.round(total, 5).alias("total"))


@query("""SELECT label, count(*) AS n, true AS close FROM embeddings GROUP BY label""")
def half_arrays_read(spark, d):
    """Float16 assets: every value comes back within half a unit of its last place."""
    e, root = load(spark, d, "embeddings").select("label", "vec_id", "embedding"), scratch(spark, "halves")
    packed = sinks.packed_arrays(e, "label", "vec_id", "embedding", "float16")
    sinks.write_blobs(packed.select(F.concat(F.lit("h_"), F.col("label").cast("string"), F.lit(".bin")).alias("p"), "content"), "p", "content", root)
    from pyspark.sql import Window

    read = T.raw_arrays(spark, root, "float16", 64).select(F.regexp_extract("path", r"h_(\d+)\.bin$", 1).cast("int").alias("label"), "row", "values")
    placed = e.withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("bigint") - 1)
    near = F.forall(F.zip_with("embedding", "values", lambda a, b: F.abs(a - b) <= F.abs(a) / 2048 + 6e-8), lambda x: x)
    return placed.join(read, ["label", "row"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(near).alias("close"))


@query("""SELECT label, round(e[3]::DOUBLE, 6) AS third FROM (SELECT label, min_by(embedding, vec_id) AS e FROM embeddings GROUP BY label)""")
def byte_range_read(spark, d):
    """Bytes 8 to 12 of each asset: the third value of its first row."""
    root = scratch(spark, "ranges")
    packed = sinks.packed_arrays(load(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", "float32")
    sinks.write_blobs(packed.select(F.concat(F.lit("r_"), F.col("label").cast("string"), F.lit(".bin")).alias("p"), "content"), "p", "content", root)
    files = spark.read.format("binaryFile").load(root)
    part = T.byte_range(files, 8, 12)
    # little-endian float32 from its four bytes
    word = F.conv(F.array_join(F.reverse(F.expr("transform(sequence(1, 4), i -> hex(substring(part, i, 1)))")), ""), 16, 10).cast("bigint")
    sign = F.when(F.shiftright(word, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(word, 23).bitwiseAND(255), word.bitwiseAND(0x7FFFFF)
    value = sign * F.pow(F.lit(2.0), exponent - 127) * (1 + fraction / F.lit(8388608.0))
    return part.select(F.regexp_extract("path", r"r_(\d+)\.bin$", 1).cast("int").alias("label"), F.round(F.when(word == 0, 0.0).otherwise(value), 6).alias("third"))


_MANIFEST = "SELECT DISTINCT ON (pack_id) pack_id, pack_version, model, image, prediction FROM pack_manifest"


@query(f"""WITH m AS ({_MANIFEST}) SELECT pack_version, count(*) AS n, count(*) FILTER (NOT coalesce(regexp_matches(pack_version, '^[0-9]+\\.[0-9]+\\.[0-9]+$'), false)) AS bad_version,
 count(*) FILTER (NOT coalesce(model.num_layers > 0, false)) AS bad_layers, count(*) FILTER (NOT coalesce(model.num_heads > 0, false)) AS bad_heads, count(*) FILTER (NOT coalesce(image.width > 0, false)) AS bad_width, count(*) FILTER (NOT coalesce(image.height > 0, false)) AS bad_height, count(*) FILTER (NOT coalesce(prediction.class_index >= 0, false)) AS bad_class, count(*) FILTER (NOT coalesce(isfinite(prediction.confidence) AND prediction.confidence BETWEEN 0 AND 1, false)) AS bad_confidence FROM m GROUP BY pack_version""")
def manifests_read(spark, d):
    """Manifests written as one JSON document a line and read under the pack schema, with the rules each breaks."""
    rows, path = load(spark, d, "pack_manifest").dropDuplicates(["pack_id"]), scratch(spark, "manifests")
    c = F.col("prediction.confidence")
    finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)  # JSON has no other numbers
    sinks.write_documents(rows.select("pack_version", "model", "image", F.struct("prediction.label", "prediction.class_index", finite.alias("confidence")).alias("prediction")), path)
    found = spark.read.schema(T.MANIFEST).option("mode", "FAILFAST").json(path).withColumn("violations", T.manifest_violations())
    breaks = lambda name: F.count(F.when(F.array_contains("violations", name), 1))
    return found.groupBy("pack_version").agg(F.count(F.lit(1)).alias("n"), breaks("pack_version").alias("bad_version"), breaks("model.num_layers").alias("bad_layers"), breaks("model.num_heads").alias("bad_heads"), breaks("image.width").alias("bad_width"), breaks("image.height").alias("bad_height"), breaks("prediction.class_index").alias("bad_class"), breaks("prediction.confidence").alias("bad_confidence"))


@query("""WITH n AS (SELECT DISTINCT ON (node_id) * FROM sgp_node), s AS (SELECT bundle_id, count(*) AS k, max(grid.z) + 1 AS gz, max(grid.y) + 1 AS gy, max(grid.x) + 1 AS gx, min(idx) AS lo, max(idx) AS hi, count(*) FILTER (coalesce(len(weight), 0) <> 64) AS short FROM n GROUP BY bundle_id)
SELECT bundle_id, k::BIGINT AS k, (k = gz * gy * gx) AS full_grid, (lo >= 0 AND hi < k) AS indices_fit, (short = 0) AS same_shape FROM s""")
def bundle_sections_read(spark, d):
    """Bundles as nested documents, their sections checked: K is the size of the grid, indices are in it, slices have one shape."""
    n, path = load(spark, d, "sgp_node").dropDuplicates(["node_id"]), scratch(spark, "bundles")
    # a bundle is one document of bounded size, as it is published
    one = n.groupBy("bundle_id").agg(F.collect_list(F.struct("idx", "grid", F.coalesce(F.size("weight"), F.lit(-1)).alias("width"))).alias("nodes"))
    sinks.write_documents(one, path)
    node = "struct<idx:int,grid:struct<z:int,y:int,x:int>,width:int>"
    read = spark.read.schema(f"bundle_id string, nodes array<{node}>").option("mode", "FAILFAST").json(path)
    size = F.size("nodes")
    axis = lambda c: F.array_max(F.transform("nodes", lambda x: x["grid"][c])) + 1
    within = F.forall("nodes", lambda x: (x["idx"] >= 0) & (x["idx"] < size))
    return read.select("bundle_id", size.cast("bigint").alias("k"), (size == axis("z") * axis("y") * axis("x")).alias("full_grid"), within.alias("indices_fit"), F.forall("nodes", lambda x: x["width"] == 64).alias("same_shape"))


@query("SELECT vec_id, label, true AS close FROM embeddings")
def quantized_asset_read(spark, d):
    """Vectors kept as bytes of their row's maximum: no value that is not negative is off by more than half a step."""
    e, path = load(spark, d, "embeddings"), scratch(spark, "quantized")
    sinks.write_quantized(e, "embedding", path)
    back = sinks.read_quantized(spark, path, "embedding").select("vec_id", F.col("embedding").alias("back"))
    step = F.when(F.array_max("embedding") > 0, F.array_max("embedding")).otherwise(1.0) / 255
    near = F.forall(F.zip_with("embedding", "back", lambda a, b: (a < 0) | (F.abs(a - b) <= step * 0.501)), lambda x: x)
    return e.join(back, "vec_id").select("vec_id", "label", near.alias("close"))


@query("""SELECT 'edges' AS asset, count(*) AS n_rows, 'l_orderkey,l_partkey,l_quantity' AS columns FROM lineitem UNION ALL SELECT 'nodes', count(*), 'p_partkey,p_name' FROM part""")
def pack_committed(spark, d):
    """The tables of a pack, written before the manifest that names them."""
    path = scratch(spark, "pack")
    sinks.commit_pack({"nodes": load(spark, d, "part").select("p_partkey", "p_name"), "edges": load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")}, path)
    return spark.read.parquet(f"{path}/_manifest_table").select("asset", F.col("rows").alias("n_rows"), "columns")


@query("""WITH new AS (SELECT o_orderkey, 'late' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM new""")
def rows_upserted(spark, d):
    """Rows that come anew replace those of their key; of several the last counts.  The table is written and read again."""
    old, path = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice")), scratch(spark, "upsert")
    fresh = old.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("late").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("turn"))
    early = fresh.withColumn("o_orderstatus", F.lit("early")).withColumn("turn", F.lit(1))
    merged = sinks.upserted(old.withColumn("turn", F.lit(0)), fresh.unionByName(early), ["o_orderkey"], "turn")
    sinks.storage("parquet", path)(merged.drop("turn"), "orders")
    return spark.read.parquet(f"{path}/orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""SELECT 'orders' AS tbl, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey % 7 <> 0""")
def delete_cascaded(spark, d):
    """Parents that are deleted take the rows of their children along."""
    orders, items = load(spark, d, "orders"), load(spark, d, "lineitem")
    left = sinks.without_children(orders, {"lineitem": (items, "l_orderkey")}, "o_orderkey", orders.filter("o_orderkey % 7 = 0").select("o_orderkey"))
    count = lambda name, key: left[key].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
    return count("orders", "").unionByName(count("lineitem", "lineitem"))


@query("""SELECT i, j, round(c, 9) AS c FROM (SELECT l_suppkey AS i, l_partkey AS j, avg(l_discount) AS c FROM lineitem GROUP BY ALL)""")
def state_round_trip(spark, d):
    """The state of an online memory, written as a table and loaded again."""
    path = scratch(spark, "state")
    state = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.avg("l_discount").alias("c"))
    sinks.write_rows(state, path)
    return spark.read.parquet(path).select("i", "j", F.round("c", 9).alias("c"))

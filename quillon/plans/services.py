"""Metadata reads, registries, seams, uploads and streams: each read from or run over whole tables."""

from pyspark.sql import functions as F

from .. import config, providers
from ..operators.positions import scratch
from ..session import load
from ..sources import sinks
from ..sources import tables as T
from ..streaming import jobs
from .registry import query

_PACKS = "p AS (SELECT DISTINCT ON (pack_id) pack_id, run_id, dataset_id, model, image, prediction FROM pack_manifest)"


def _backend(spark, d):
    """The four metadata tables, written as one JSON document each and read by the backend of documents."""
    root, packs = scratch(spark, "metadata"), load(spark, d, "pack_manifest").dropDuplicates(["pack_id"])
    put = sinks.storage("json", root)
    data = load(spark, d, "dataset_config")
    put(data.select(F.col("dataset_id").alias("id"), "name", F.col("image_size").alias("num_classes")), "datasets")
    put(packs.filter("dataset_id IS NOT NULL AND model.arch IS NOT NULL").select("dataset_id", "model.arch").distinct().select(F.concat_ws("/", "dataset_id", "arch").alias("id"), "dataset_id", "arch"), "models")
    put(packs.select(F.col("pack_id").alias("id"), "dataset_id", F.col("model.arch").alias("model_id"), F.col("prediction.label").alias("pred_label"), F.col("image.id").alias("image_id")), "gallery")
    put(load(spark, d, "concept_feature").select(F.col("feature_id").alias("id"), F.col("arch").alias("model_id"), "layer", "dataset_id"), "dictionaries")
    return T.Metadata(spark, root)


@query(f"WITH {_PACKS}, m AS (SELECT DISTINCT dataset_id, model.arch AS arch FROM p WHERE model.arch IS NOT NULL) SELECT c.dataset_id AS id, name, min(arch) AS arch FROM dataset_config c LEFT JOIN m USING (dataset_id) GROUP BY ALL")
def metadata_datasets(spark, d):
    """Datasets by name, each with its first model."""
    return _backend(spark, d).datasets().select("id", "name", "arch")


@query(f"WITH {_PACKS} SELECT pack_id AS id, model.arch AS model_id, prediction.label AS pred_label FROM p WHERE dataset_id = 'ds02'")
def metadata_gallery(spark, d):
    """The gallery of one dataset, by id."""
    return _backend(spark, d).gallery("ds02").select("id", "model_id", "pred_label")


@query(f"WITH {_PACKS} SELECT pack_id AS id, image.id AS image_id FROM p WHERE dataset_id = 'ds01' AND model.arch = 'umt_dual_l6'")
def metadata_projections(spark, d):
    """Rows by several equalities at once; of an unknown dataset there are none."""
    both = _backend(spark, d)
    nothing = both.matching("gallery", dataset_id="unknown")
    return both.matching("gallery", dataset_id="ds01", model_id="umt_dual_l6").unionByName(nothing).select("id", "image_id")


@query("SELECT min(feature_id) AS id, 9 AS layer FROM concept_feature WHERE arch = 'umt_dual_l12' AND layer = 9 HAVING count(*) > 0")
def metadata_dictionary(spark, d):
    """The dictionary of a model and layer, or none."""
    return _backend(spark, d).dictionary("umt_dual_l12", 9).select("id", F.col("layer").cast("int").alias("layer"))


@query("""SELECT dataset_id, loader, CASE WHEN loader = 'csv' AND path_column IS NULL THEN 'path_column' WHEN abs(splits.train + splits.val + splits.test - 1) > 1e-6 THEN 'splits' WHEN loader NOT IN ('csv', 'imagefolder', 'shapes') THEN 'loader' ELSE '' END AS broken FROM dataset_config""")
def settings_checked(spark, d):
    """Every dataset's settings put through the rules; the first field that breaks one is named."""

    def first_broken(rows):
        import pandas as pd

        for batch in rows:
            out = []
            for r in batch.itertuples():
                values = {"loader": r.loader, "path_column": r.path_column, "splits": {k: r.splits[k] for k in ("train", "val", "test")}}
                try:
                    config.Settings(values)
                    out.append("")
                except config.ConfigError as error:
                    out.append(str(error).split(":")[0])
            yield pd.DataFrame({"dataset_id": batch["dataset_id"], "loader": batch["loader"], "broken": out})

    return load(spark, d, "dataset_config").select("dataset_id", "loader", "path_column", "splits").mapInPandas(first_broken, "dataset_id string, loader string, broken string")


@query("""SELECT dataset_id, CASE augmentation WHEN 'dermoscopy_default' THEN 180 WHEN 'natural_default' THEN 15 END AS rot, coalesce(augmentation = 'satellite_default', false) AS rot90 FROM dataset_config""")
def augmentation_policies(spark, d):
    """What each dataset's augmentation policy switches on."""
    rows = [(name, ops.get("rot"), bool(ops.get("rot90"))) for name, ops in config.POLICIES.items()]
    known = spark.createDataFrame(rows, "augmentation string, rot int, rot90 boolean")
    return load(spark, d, "dataset_config").join(F.broadcast(known), "augmentation", "left").select("dataset_id", "rot", F.coalesce("rot90", F.lit(False)).alias("rot90"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[:3], lambda x: (x::DOUBLE - 0.5) / 0.5)), 6) AS total FROM embeddings")
def normalized_channels(spark, d):
    """Channels less their mean over their deviation; what a dataset does not give is one half."""
    mean, std = config.normalization(3)
    scaled = F.zip_with(F.slice("embedding", 1, 3), F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(mean, std)]), lambda x, c: (x.cast("double") - c["m"]) / c["s"])
    return load(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {_PACKS} SELECT DISTINCT dataset_id AS dataset, model.arch AS model, model.num_layers AS num_layers FROM p WHERE dataset_id IS NOT NULL AND model.arch IS NOT NULL AND model.num_layers IS NOT NULL")
def model_list(spark, d):
    """Registered models by dataset: every model of the packs is filed once, and joined to the datasets that have it."""
    packs = load(spark, d, "pack_manifest").filter("dataset_id IS NOT NULL AND model.arch IS NOT NULL AND model.num_layers IS NOT NULL").select("dataset_id", "model").distinct()
    for r in packs.select("model").distinct().collect():  # architectures, a handful
        name = f"{r.model.arch}:{r.model.num_layers}:{r.model.num_heads}"
        if name not in {m.name for m in providers.models(spark).select("name").collect()}:
            providers.register_model(name, providers.Model(r.model.arch, num_layers=r.model.num_layers, num_heads=r.model.num_heads or 0))
    key = F.concat_ws(":", "model.arch", F.col("model.num_layers").cast("string"), F.col("model.num_heads").cast("string"))
    filed = providers.models(spark).select("name", "arch", "num_layers")
    return packs.withColumn("name", key).join(F.broadcast(filed), "name").select(F.col("dataset_id").alias("dataset"), F.col("arch").alias("model"), "num_layers").distinct()


@query("""WITH n AS (SELECT DISTINCT ON (node_id) * FROM sgp_node) SELECT bundle_id AS graph, count(*) AS n_nodes, count(community) AS n_labelled, count(DISTINCT community) AS n_communities FROM n GROUP BY bundle_id""")
def provided_graphs(spark, d):
    """A graph provider's nodes and communities, counted."""
    graph: providers.GraphProvider = providers.LatticeGraph(load(spark, d, "sgp_node"))
    n = graph.nodes().groupBy(F.col("bundle_id").alias("graph")).agg(F.count(F.lit(1)).alias("n_nodes"))
    c = graph.communities().groupBy("graph").agg(F.count(F.lit(1)).alias("n_labelled"), (F.max("community") + 1).alias("n_communities"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return n.join(c, "graph", "left").select("graph", "n_nodes", zero("n_labelled"), zero("n_communities"))


@query("""WITH o AS (SELECT vec_id, i - 1 AS feature, greatest(e[i]::DOUBLE - 0.05, 0) AS a FROM (SELECT vec_id, embedding AS e FROM embeddings), range(1, 17) t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, feature) AS p FROM o WHERE a > 0) SELECT vec_id, list(feature ORDER BY p) AS feature_ids, round(list_sum(list(a ORDER BY p)), 6) AS total FROM k WHERE p <= 4 GROUP BY vec_id""")
def provided_concepts(spark, d):
    """A concept provider's codes as a pack holds them: the four strongest features of each row."""
    import numpy as np

    concepts: providers.ConceptProvider = providers.DictionaryConcepts("vec_id", "embedding", np.eye(16, 64), np.full(64, 0.05), 16)
    pack = providers.concept_pack(concepts.encode(load(spark, d, "embeddings")), "vec_id", "feature", "activation", 4)
    return pack.select("vec_id", "feature_ids", F.round(F.aggregate("activations", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT feature_id, CASE WHEN len(exemplars) >= 3 THEN 'seen ' || len(exemplars) ELSE coalesce(suggested_label, 'feature #' || feature_id) END AS label FROM concept_feature""")
def hooked_labels(spark, d):
    """Labels by a hook over the exemplars, else as suggested, else by number."""
    hook = lambda feature, exemplars: F.when(F.size(exemplars) >= 3, F.concat(F.lit("seen "), F.size(exemplars).cast("string")))
    fallback = F.coalesce("suggested_label", F.concat(F.lit("feature #"), F.col("feature_id").cast("string")))
    return providers.labelled(load(spark, d, "concept_feature"), hook, fallback).select("feature_id", "label")


@query("""SELECT doc_id, CASE WHEN strlen(text) > 20000 THEN 413 WHEN coalesce(strlen(text), 0) = 0 THEN 400 ELSE 202 END AS status, CASE WHEN strlen(text) BETWEEN 1 AND 20000 THEN substr(sha256(text), 1, 12) END AS job_id FROM documents""")
def uploads_checked(spark, d):
    """Uploads that are too large, empty, or taken with the id of their job."""
    rows = load(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return providers.Analysis.checked(rows, "body", 20_000).select("doc_id", "status", "job_id")


@query("""SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE strlen(text) BETWEEN 1 AND 10485760 GROUP BY source""")
def analysis_run(spark, d):
    """The analyzer is given what was taken, and may be any function of tables."""
    analysis = providers.Analysis(lambda taken: taken.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).cast("bigint").alias("bytes")))
    return analysis.run(load(spark, d, "documents").select("source", F.encode("text", "UTF-8").alias("body")), "body")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'job/' || p_brand || '/a.bin' WHEN 2 THEN 'job/' || p_brand WHEN 3 THEN NULL ELSE 'job/b.bin' END AS path FROM part""")
def asset_paths(spark, d):
    """Paths of assets inside their job's folder; those that would leave it have none."""
    brand = F.col("p_brand")
    asset = F.element_at(F.array(F.lit("../other/a.bin"), F.concat(brand, F.lit("//./a.bin")), F.concat(F.lit("x/../"), brand), F.concat(F.lit("/"), brand), F.lit("x/y/../../b.bin")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", providers.inside(F.lit("job"), asset).alias("path"))


@query("SELECT i::INTEGER AS place, c AS channel FROM (SELECT unnest(['x', 'y', 'rx', 'ry', 'theta', 'opacity', 'glow', 'halo']) AS c, generate_subscripts(['x', 'y', 'rx', 'ry', 'theta', 'opacity', 'glow', 'halo'], 1) - 1 AS i)")
def field_channels(spark, d):
    """The order of a field's channels, read from the table it was written to."""
    from ..operators import attribution as A

    path = scratch(spark, "field")
    good = load(spark, d, "exemplar_ref").filter("token_idx IS NOT NULL AND activation > 0 AND activation < double('inf')")
    tokens = good.groupBy(F.col("token_idx").alias("token")).agg(F.avg("activation").alias("size"), F.max("activation").alias("score"))
    edges = good.groupBy(F.col("token_idx").alias("dst"), ((F.col("token_idx") + 1) % 197).alias("src")).agg(F.lit(1.0).alias("w"))
    sinks.write_rows(A.token_field(tokens, edges, 14), path)
    return spark.createDataFrame(list(enumerate(A.channels(spark.read.parquet(path)))), "place int, channel string")


@query("""WITH r AS (SELECT image_id, min(row_id) AS row_id FROM image_metadata WHERE image_id IS NOT NULL GROUP BY image_id), s AS (SELECT image_id, row_id, row_number() OVER (ORDER BY md5(image_id || '-5'), image_id) AS k FROM r) SELECT image_id, row_id FROM s WHERE k <= 64""")
def seeded_subset(spark, d):
    """A sampling operator: a seeded subset of at most 64 images."""
    rows = load(spark, d, "image_metadata").filter("image_id IS NOT NULL").groupBy("image_id").agg(F.min("row_id").alias("row_id"))
    return rows.orderBy(F.md5(F.concat(F.col("image_id"), F.lit("-5"))), "image_id").limit(64)


@query("""WITH v AS (SELECT feat_id, min(image_id) AS image_id FROM frozen_feature WHERE split = 'val' GROUP BY feat_id ORDER BY feat_id LIMIT 32), m AS (SELECT image_id, min(row_id) AS row_id, min_by(dx, row_id) AS dx FROM image_metadata GROUP BY image_id) SELECT feat_id, v.image_id, row_id, m.dx FROM v LEFT JOIN m USING (image_id)""")
def probe_batch(spark, d):
    """A sampling operator: the first 32 validation rows, each with its attribute row."""
    first = load(spark, d, "frozen_feature").filter("split = 'val'").groupBy("feat_id").agg(F.min("image_id").alias("image_id")).orderBy("feat_id").limit(32)
    m = load(spark, d, "image_metadata").filter("image_id IS NOT NULL").groupBy("image_id").agg(F.min("row_id").alias("row_id"), F.min_by("dx", "row_id").alias("dx"))
    return first.join(m, "image_id", "left").select("feat_id", "image_id", "row_id", "dx")


@query("""SELECT split, count(*) AS n, count(*) FILTER (view = 1) AS n_second FROM (SELECT coalesce(split, 'none') AS split, unnest(CASE WHEN split = 'train' THEN [0, 1] ELSE [0] END) AS view FROM (SELECT DISTINCT ON (feat_id) * FROM frozen_feature)) GROUP BY split""")
def view_rows(spark, d):
    """Training rows come in two views, all others in one."""
    from ..operators.splitting import views

    rows = load(spark, d, "frozen_feature").select("feat_id", F.coalesce("split", F.lit("none")).alias("split")).dropDuplicates(["feat_id"])
    v = views(rows, "split")
    return v.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("view") == 1, 1)).alias("n_second"))


@query("""WITH r AS (SELECT DISTINCT ON (feat_id) run_id, label, pooled FROM frozen_feature) SELECT run_id, count(*) AS n, CASE WHEN bool_or(coalesce(label, -1) < 0) THEN NULL ELSE count(DISTINCT label) END AS n_classes FROM r WHERE len(pooled) = 64 GROUP BY run_id""")
def frozen_features(spark, d):
    """Extracted features by run; one label that is missing or below zero makes the run unlabelled."""
    rows = load(spark, d, "frozen_feature").dropDuplicates(["feat_id"]).filter(F.size("pooled") == 64)
    one = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("label", F.lit(-1)) < 0).alias("open"), F.countDistinct("label").alias("c"))
    return one.select("run_id", "n", F.when(~F.col("open"), F.col("c")).alias("n_classes"))


@query("SELECT label, count(*) AS n, true AS sized, true AS told_apart FROM (SELECT (i % 3)::INTEGER AS label FROM (SELECT count(*) AS c FROM orders), range(0, 300) t(i)) GROUP BY label")
def made_shapes(spark, d):
    """A procedural source: images of three shapes by class and seed, the same whenever they are made."""
    made = T.shapes(spark, 300, 24, seed=3)
    again = T.shapes(spark, 300, 24, seed=3).select("item", F.sha2("pixels", 256).alias("again"))
    both = made.withColumn("mark", F.sha2("pixels", 256)).join(again, "item")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.octet_length("pixels") == 24 * 24).alias("sized"), (F.bool_and(F.col("mark") == F.col("again")) & (F.countDistinct("mark") > 50)).alias("told_apart"))


def _drained(spark, d, columns, name):
    """The events as a stream over their own files."""
    path = scratch(spark, name)
    rows = load(spark, d, "events").dropDuplicates(["event_id"]).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").select(*columns)
    rows.repartition(4).write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


@query("""WITH t AS (SELECT DISTINCT ON (event_id) * FROM events), p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) - 1 AS back, count(*) OVER (PARTITION BY user_id) AS n FROM t WHERE value IS NOT NULL)
SELECT user_id, round(sum(0.2 * power(0.8, back) * value), 6) AS ema, max(n) AS n FROM p WHERE user_id IS NOT NULL GROUP BY user_id""")
def streamed_ema(spark, d):
    """Exponential average of every user as a stream keeps it: state by key, in the order of time within a batch."""
    s, path = _drained(spark, d, ["user_id", "ts", "value"], "ema")
    sink = lambda batch, number: batch.write.mode("append").parquet(f"{path}/out")
    q = jobs.smoothed(s.filter("user_id IS NOT NULL"), "user_id", "value", 0.2).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("user_id").agg(F.round(F.max_by("ema", "n"), 6).alias("ema"), F.max("n").alias("n"))


@query("""WITH t AS (SELECT DISTINCT ON (event_id) * FROM events) SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM t WHERE ts IS NOT NULL GROUP BY ALL""")
def streamed_counts(spark, d):
    """Counts by hour and kind of a stream with a watermark."""
    s, path = _drained(spark, d, ["ts", "event_type"], "counts")
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out")
    q = jobs.windowed_counts(s, "ts", "event_type").writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.to_timestamp_ntz(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")).alias("hour"), "event_type", "n")


@query("""WITH t AS (SELECT DISTINCT ON (event_id) * FROM events), q AS (SELECT user_id AS id, (ascii(event_type) * 1000 + length(event_type))::BIGINT AS unit, sum(value) AS q FROM t WHERE event_type <> 'view' AND value IS NOT NULL GROUP BY ALL), l AS (SELECT id, sqrt(sum(q * q)) + 1e-8 AS l FROM q GROUP BY id), a AS (SELECT q.id, unit, q / l AS a FROM q JOIN l ON q.id = l.id)
SELECT x.unit AS i, y.unit AS j, round(0.1 * sum(x.a * y.a) / (SELECT count(*) FROM l), 6) AS c FROM a x JOIN a y ON x.id = y.id AND x.unit <= y.unit GROUP BY ALL""")
def streamed_coactivation(spark, d):
    """Co-activation learned from a stream: one batch of training rows into an empty state; other phases are looked at only."""
    s, path = _drained(spark, d, ["user_id", "event_type", "value"], "online")
    memory = jobs.OnlineCoactivation(f"{path}/state")
    rows = s.select(F.col("user_id").alias("id"), (F.ascii("event_type") * 1000 + F.length("event_type")).cast("bigint").alias("unit"), "value", F.when(F.col("event_type") == "view", "val").otherwise("train").alias("phase"))
    q = rows.writeStream.foreachBatch(memory.merge).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return memory.state(spark, 0).select("i", "j", F.round("c", 6).alias("c"))


@query("SELECT unnest(['load', 'metrics', 'done']) AS stage, unnest(['ok', 'ok', '2']) AS message")
def streamed_stages(spark, d):
    """A stream of jobs through named stages; the log has a row for each, and ends with done."""
    s, path = _drained(spark, d, ["event_id", "event_type", "value"], "stages")
    stages = [("load", lambda df: df.filter("value IS NOT NULL")), ("metrics", lambda df: df.groupBy("event_type").agg(F.avg("value").alias("mean")))]
    jobs.run_stages(s, stages, f"{path}/log", f"{path}/cp").awaitTermination()
    return spark.read.parquet(f"{path}/log").select("stage", "message")


@query("""WITH t AS (SELECT DISTINCT ON (event_id) * FROM events) SELECT event_type AS metric, count(*) AS n, round(avg(value), 9) AS mean FROM t GROUP BY event_type""")
def streamed_metrics(spark, d):
    """Metrics of each batch handed to a callback, summed up over all batches."""
    s, path = _drained(spark, d, ["event_type", "value"], "metrics")

    def observe(batch, number):
        batch.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("m"), F.sum("value").alias("s")).write.mode("append").parquet(f"{path}/out")

    s.writeStream.foreachBatch(observe).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("metric").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("m"), 9).alias("mean"))

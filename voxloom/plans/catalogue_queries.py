"""Queries of catalogues, splits, batches and checkpoints."""

import uuid

from pyspark.sql import functions as F

from voxloom.catalog import query
from voxloom.functions.nulls import six
from voxloom.functions.tables import shared_folder
from voxloom.operators import catalogue
from voxloom.plans.fixtures import BLOB, read, with_
from voxloom.sources import files

PATHS = "paths AS (SELECT page_id, './imagesTr/amos_' || lpad(page_id::VARCHAR, 4, '0') || '.nii.gz' AS path FROM pages)"
CKPT = "ckpt AS (SELECT o_custkey AS run, o_orderkey AS step, o_orderpriority AS metric, floor(o_totalprice / 50000) AS value FROM orders)"
#: Metrics of the checkpoints.
METRICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SLOTS = "slots AS (SELECT conv_id AS batch, turn::INT AS slot, length(text) AS value, CASE WHEN turn % 5 = 3 THEN '' ELSE conv_id || '-' || turn END AS uid FROM conversations)"


def paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").selectExpr("page_id", "concat('./imagesTr/amos_', lpad(cast(page_id AS string), 4, '0'), '.nii.gz') AS path")


def checkpoints(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_custkey AS run", "o_orderkey AS step", "o_orderpriority AS metric", "cast(floor(o_totalprice / 50000) AS double) AS value")


def slots(spark, sf_dir):
    return read(spark, sf_dir, "conversations").selectExpr("conv_id AS batch", "cast(turn AS int) AS slot", "cast(length(text) AS long) AS value", "CASE WHEN turn % 5 = 3 THEN '' ELSE concat(conv_id, '-', turn) END AS uid")


@query("A04_manifest_paths", with_(PATHS) + "SELECT page_id, path, (row_number() OVER (PARTITION BY page_id // 1000 ORDER BY page_id) - 1)::INT AS place FROM paths")
def manifest(spark, sf_dir):
    """A JSON manifest for every thousand pages, written as a file each and read back in order."""
    at = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    entries = F.array_sort(F.collect_list(F.struct("page_id", "path")))
    texts = paths(spark, sf_dir).groupBy(F.floor(F.col("page_id") / 1000).alias("manifest")).agg(F.to_json(F.struct(entries.alias("training"))).alias("value"))
    texts.write.partitionBy("manifest").text(at)
    return files.read_manifest(spark, at, "training").select("page_id", "path", "place")


_NESTED = "struct<user:struct<id:long,kind:string>,value:double>"


@query("A08_flatten_record", "SELECT event_id, user_id AS record_user_id, event_type AS record_user_kind, round(value, 6) AS record_value FROM events")
def flatten(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    nested = e.select("event_id", F.from_json(F.to_json(F.struct(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user"), "value")), _NESTED).alias("record"))
    return catalogue.flatten(nested).withColumn("record_value", six("record_value"))


@query("A07_first_examples", with_(BLOB) + "SELECT uid, count(*) AS voxels, sum(label_true)::BIGINT AS labels FROM blob WHERE uid % 3 = 0 AND uid IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 ORDER BY p_partkey LIMIT 20) GROUP BY uid")
def first_examples(spark, sf_dir):
    """A split's first 20 examples: headers are cut first, and voxels follow by a semi join."""
    from voxloom.plans.fixtures import blob_headers, blob_labels

    heads = blob_headers(spark, sf_dir).where("uid % 3 = 0").select("uid").orderBy("uid").limit(20)
    return blob_labels(spark, sf_dir).join(heads, "uid", "left_semi").groupBy("uid").agg(F.count("*").alias("voxels"), F.sum("label_true").alias("labels"))


@query("B01_drop_key", "SELECT p_name, p_size FROM part")
def drop_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").drop("p_partkey")


@query("B02_modality_filter", with_(PATHS) + "SELECT page_id FROM paths WHERE page_id <= 500")
def modality_filter(spark, sf_dir):
    return catalogue.keep_modality(paths(spark, sf_dir)).select("page_id")


@query("B03_path_to_uid", with_(PATHS) + "SELECT page_id, lpad(page_id::VARCHAR, 4, '0') AS uid FROM paths")
def path_to_uid(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", catalogue.path_to_uid(F.col("path")).alias("uid"))


@query("B05_unpad", with_(SLOTS) + "SELECT batch, slot, uid FROM (SELECT *, min(CASE WHEN uid = '' THEN slot END) OVER (PARTITION BY batch) AS f FROM slots) WHERE f IS NULL OR slot < f")
def unpad(spark, sf_dir):
    return catalogue.unpad(slots(spark, sf_dir), "batch", "slot", "uid").select("batch", "slot", "uid")


@query("B06_pad_batch", with_(SLOTS) + ", g AS (SELECT DISTINCT batch, unnest(range(0, 8))::INT AS slot FROM slots) SELECT g.batch, g.slot, coalesce(value, 0)::BIGINT AS value, s.batch IS NULL AS padded FROM g LEFT JOIN slots s ON s.batch = g.batch AND s.slot = g.slot")
def pad(spark, sf_dir):
    rows = slots(spark, sf_dir).select("batch", "slot", "value")
    return catalogue.pad_batches(rows, "batch", "slot", 8, ["value"]).select("batch", "slot", "value", "padded")


@query("C01_image_label_pairs", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def pairs(spark, sf_dir):
    return catalogue.pair_images(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("C02_all_modalities", "SELECT user_id, ts::DATE AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def all_modalities(spark, sf_dir):
    files = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("modality"))
    return catalogue.complete_uids(files, 5, ["user_id", "day"])


@query("G01_intersect", "SELECT user_id, ts::DATE AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 5")
def intersect(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    kinds = e.agg(F.countDistinct("event_type")).first()[0]
    return catalogue.complete_uids(e.withColumnRenamed("event_type", "modality"), kinds, ["user_id", "day"])


@query("G02_union_batches", "SELECT metric, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT 'price' AS metric, o_totalprice AS v FROM orders UNION ALL SELECT 'balance', c_acctbal FROM customer) GROUP BY metric")
def union_batches(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.lit("price").alias("metric"), F.col("o_totalprice").alias("v"))
    b = read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"), F.lit("balance").alias("metric"))
    return a.unionByName(b).groupBy("metric").agg(F.count("*").alias("n"), six(F.sum("v")).alias("total"))


@query("G03_merge_families", "SELECT uid, metric, value FROM (SELECT p_partkey AS uid, 'size' AS metric, p_size::DOUBLE AS value FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'size', -p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_partkey % 2 = 0)")
def merge(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    even = p.where("p_partkey % 2 = 0")
    a = p.selectExpr("p_partkey AS uid", "'size' AS metric", "cast(p_size AS double) AS value")
    b = even.selectExpr("p_partkey AS uid", "'size' AS metric", "cast(-p_size AS double) AS value").unionByName(even.selectExpr("p_partkey AS uid", "'price' AS metric", "p_retailprice AS value"))
    return catalogue.merge_families([a, b], ["uid", "metric"])


@query("G04_mask_union", with_(BLOB) + "SELECT uid, count(*) AS voxels, min(x) AS lo_x, max(x) AS hi_x FROM (SELECT uid, x, y FROM blob WHERE label_true > 0 UNION SELECT uid, x, y FROM blob WHERE label_pred > 0) GROUP BY uid")
def mask_union(spark, sf_dir):
    from voxloom.plans.fixtures import blob_labels

    blob = blob_labels(spark, sf_dir)
    both = blob.where("label_true > 0").select("uid", "x", "y").union(blob.where("label_pred > 0").select("uid", "x", "y")).distinct()
    return both.groupBy("uid").agg(F.count("*").alias("voxels"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x"))


@query("C03_geometry_check", """SELECT uid, field FROM (SELECT s_suppkey AS uid, abs(s_acctbal), s_suppkey % 5 AS k, unnest(['spacing', 'origin']) AS field FROM supplier) WHERE (k = 1 AND field = 'spacing') OR (k = 2 AND field = 'origin')""")
def geometry(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"), F.lit([32, 32]).alias("shape"), (F.abs("s_acctbal") / 5000 + 0.5).alias("v"), k.alias("k"))
    a = s.select("uid", "shape", F.array("v", "v").alias("spacing"), F.array("v", F.lit(0.0)).alias("origin"))
    b = s.select("uid", "shape", F.array("v", F.col("v") + F.when(F.col("k") == 1, 0.01).otherwise(0.0005)).alias("spacing"), F.array(F.col("v") + F.when(F.col("k") == 2, 0.01).otherwise(0.0), F.lit(0.0005)).alias("origin"))
    return catalogue.geometry_violations(a, b, ["spacing", "origin"])


_GROUPS = "g AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM (SELECT doc_id, concat_ws('-', source, doc_id % 10) AS k FROM documents)), h AS (SELECT *, CASE WHEN floor(n * 0.75) - 2 < 0 THEN greatest(floor(n * 0.75) - 2 + n, 0) ELSE floor(n * 0.75) - 2 END AS e FROM g)"


@query("E06_split_by_group", with_(_GROUPS) + "SELECT doc_id, 'valid' AS split FROM h WHERE i < 2 UNION ALL SELECT doc_id, 'train' FROM h WHERE i >= 2 AND i < e UNION ALL SELECT doc_id, 'test' FROM h WHERE i >= e")
def split_by_group(spark, sf_dir):
    """Groups by source and the identifier's last digit: some are small, and overlap."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", F.col("doc_id") % 10).alias("k"))
    return catalogue.split_by_group(rows, "k", "doc_id").select("doc_id", "split")


@query("E07_split_by_ratio", "SELECT page_id, CASE WHEN row_number() OVER (ORDER BY page_id) <= floor((SELECT count(*) FROM pages) * 0.1) THEN 'valid' ELSE 'test' END AS split FROM pages")
def split_by_ratio(spark, sf_dir):
    return catalogue.split_by_ratio(read(spark, sf_dir, "pages").select("page_id"), "page_id")


@query("E08_split_by_count", "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= 938 THEN 'train' WHEN row_number() OVER (ORDER BY c_custkey DESC) <= 282 THEN 'test' ELSE 'valid' END AS split FROM customer")
def split_by_count(spark, sf_dir):
    return catalogue.split_by_count(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 938, 282)


#: Each run's history folded in step order: a run goes on until three checks in a row fail to beat the best by more than 0.5.
EARLY = "WITH RECURSIVE " + CKPT + """, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM ckpt),
f AS (SELECT run, step, k, value AS best, 0 AS wait FROM o WHERE k = 1
  UNION ALL SELECT o.run, o.step, o.k, CASE WHEN o.value - f.best > 0.5 THEN o.value ELSE f.best END, CASE WHEN o.value - f.best > 0.5 THEN 0 ELSE f.wait + 1 END FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1 WHERE f.wait < 3),
"""


@query("E13_early_stopping", EARLY + "l AS (SELECT run, max(CASE WHEN wait >= 3 THEN step END) AS stop_step, max(best) AS best FROM f GROUP BY run) SELECT * FROM l")
def early_stopping(spark, sf_dir):
    return catalogue.early_stop(checkpoints(spark, sf_dir), 3, 0.5)


@query("F01_best_checkpoint", with_(CKPT) + "SELECT run, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS k FROM ckpt) WHERE k = 1")
def best(spark, sf_dir):
    return catalogue.best_checkpoint(checkpoints(spark, sf_dir))


@query("F04_seeded_shuffle", "SELECT c_custkey FROM customer")
def seeded_shuffle(spark, sf_dir):
    return catalogue.shuffled(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


@query("F05_batches", "SELECT c_custkey, i // 64 AS batch_id, i % 64 AS slot FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i // 64 < n // 64")
def batch(spark, sf_dir):
    return catalogue.batches(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 64, True)


@query("F06_even_split", "SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) - 1 AS shard FROM customer")
def even_split(spark, sf_dir):
    return catalogue.even_shards(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7)


@query("F07_newest_checkpoints", with_(CKPT) + "SELECT run, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM ckpt) WHERE k <= 3")
def newest(spark, sf_dir):
    return catalogue.newest(checkpoints(spark, sf_dir), 3).select("run", "step", "value")

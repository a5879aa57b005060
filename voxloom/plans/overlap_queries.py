"""Queries of masks, label maps and overlap metrics."""

from pyspark.sql import functions as F

from voxloom.catalog import query
from voxloom.functions import scalar
from voxloom.functions.nulls import six
from voxloom.functions.tables import joined
from voxloom.operators import overlap
from voxloom.plans.fixtures import BLOB, BLOB_HEADERS, CLASSES, LOGITS, NOISE, blob_headers, blob_labels, emb_logits, noise_voxels, with_

VOXELS = 32 * 32
_AXES = "x y z".split()
SUMS = with_(BLOB, BLOB_HEADERS) + """, g AS (SELECT uid, unnest(range(0, 4))::INT AS cls, s1, s2, s3 FROM heads),
s AS (SELECT g.uid, g.cls, any_value(s1) AS s1, any_value(s2) AS s2, any_value(s3) AS s3,
  count(*) FILTER (label_true = g.cls AND label_pred = g.cls) AS inter, count(*) FILTER (label_pred = g.cls) AS n_pred, count(*) FILTER (label_true = g.cls) AS n_true,
  """ + ", ".join(f"coalesce(sum(b.{a}) FILTER (label_{l} = g.cls), 0)::BIGINT AS {l[0]}_{a}" for l in ("true", "pred") for a in _AXES) + """
  FROM g LEFT JOIN blob b ON b.uid = g.uid AND (b.label_true = g.cls OR b.label_pred = g.cls) GROUP BY g.uid, g.cls)
"""  # fmt: skip


def blob_sums(spark, sf_dir):
    heads = blob_headers(spark, sf_dir)
    return joined(overlap.overlap_sums(blob_labels(spark, sf_dir), heads.select("uid"), CLASSES), heads.select("uid", "spacing"), ["uid"])


@query("B04_nested_label", with_(NOISE) + "SELECT uid, nested, count(*) AS n FROM (SELECT uid, CASE l WHEN 4 THEN 3 WHEN 1 THEN 2 WHEN 0 THEN 0 ELSE 1 END AS nested FROM (SELECT uid, CASE WHEN p_soft > 0.5 THEN 2 WHEN label_true = 2 THEN 4 ELSE label_true END AS l FROM noise)) GROUP BY ALL")
def nested_label(spark, sf_dir):
    l = F.when(F.col("p_soft") > 0.5, 2).when(F.col("label_true") == 2, 4).otherwise(F.col("label_true"))
    return noise_voxels(spark, sf_dir).select("uid", scalar.nested_label(l).alias("nested")).groupBy("uid", "nested").agg(F.count("*").alias("n"))


@query("B07_one_hot_mask", with_(NOISE) + "SELECT uid, x, y, cls, (label_true = cls)::INT AS mask FROM noise CROSS JOIN (SELECT unnest(range(0, 3))::INT AS cls)")
def one_hot(spark, sf_dir):
    rows = overlap.class_grid(noise_voxels(spark, sf_dir).select("uid", "x", "y", "label_true"), 3)
    return rows.select("uid", "x", "y", "cls", (F.col("label_true") == F.col("cls")).cast("int").alias("mask"))


@query("B08_binary_mask", with_(NOISE) + "SELECT uid, x, y, cls, ((label_true >= 1) = (cls = 1))::INT AS mask FROM noise CROSS JOIN (SELECT unnest(range(0, 2))::INT AS cls)")
def binary_mask(spark, sf_dir):
    rows = overlap.class_grid(noise_voxels(spark, sf_dir).select("uid", "x", "y", "label_true"), 2)
    return rows.select("uid", "x", "y", "cls", ((F.col("label_true") >= 1) == (F.col("cls") == 1)).cast("int").alias("mask"))


@query("B09_logits_to_label", with_(LOGITS) + "SELECT uid, v, cls AS label FROM (SELECT *, row_number() OVER (PARTITION BY uid, v ORDER BY logit DESC, cls) AS k FROM logits) WHERE k = 1")
def logits_to_label(spark, sf_dir):
    return emb_logits(spark, sf_dir).groupBy("uid", "v").agg(F.max_by("cls", F.struct("logit", -F.col("cls"))).alias("label"))


@query("B10_class_scores", with_(LOGITS) + """SELECT uid, v, cls, round(exp(logit - top) / sum(exp(logit - top)) OVER w, 6) AS softmax, round(1 / (1 + exp(-logit)), 6) AS sigmoid, round(logit - top - ln(sum(exp(logit - top)) OVER w), 6) AS log_softmax
FROM (SELECT *, max(logit) OVER (PARTITION BY uid, v) AS top FROM logits) WINDOW w AS (PARTITION BY uid, v)""")
def class_scores(spark, sf_dir):
    v, l = ["uid", "v"], F.col("logit")
    return emb_logits(spark, sf_dir).select(*v, "cls", six(scalar.softmax(l, v)).alias("softmax"), six(scalar.sigmoid(l)).alias("sigmoid"), six(scalar.log_softmax(l, v)).alias("log_softmax"))


@query("B11_diffusion_space", with_(NOISE) + """SELECT uid, x, y, round(p_soft * 2 - 1, 6) AS x0, round((greatest(least(value / 30011 - 1, 1), -1) + 1) / 2, 6) AS mask, round(ln(greatest(least((value / 30011 - 1 + 1) / 2, 1), 1e-5::DOUBLE)), 6) AS logit FROM noise""")
def diffusion_space(spark, sf_dir):
    raw = F.col("value") / 30011 - 1
    return noise_voxels(spark, sf_dir).select("uid", "x", "y", six(scalar.mask_to_x(F.col("p_soft"))).alias("x0"), six(scalar.x_to_mask(raw)).alias("mask"), six(scalar.x_to_logits(raw)).alias("logit"))


@query("B12_label_smoothing", with_(NOISE) + "SELECT uid, x, y, cls, round((label_true = cls)::INT * 0.9 + 0.1::DOUBLE / 3, 6) AS even, round((label_true = cls)::INT * 0.9 + 0.05::DOUBLE, 6) AS half FROM noise CROSS JOIN (SELECT unnest(range(0, 3))::INT AS cls)")
def label_smoothing(spark, sf_dir):
    rows = overlap.class_grid(noise_voxels(spark, sf_dir).select("uid", "x", "y", "label_true"), 3)
    mask = (F.col("label_true") == F.col("cls")).cast("double")
    return rows.select("uid", "x", "y", "cls", six(scalar.smooth_label(mask, 3, True, 0.1)).alias("even"), six(scalar.smooth_label(mask, 3, False, 0.1)).alias("half"))


@query("C04_prediction_alignment", with_(BLOB) + """, a AS (SELECT uid, x, y, label_true FROM blob WHERE label_true > 0), b AS (SELECT uid, x, y, label_pred FROM blob WHERE label_pred > 0)
SELECT coalesce(a.uid, b.uid) AS uid, count(*) AS voxels, count(a.uid) AS in_true, count(b.uid) AS in_pred, count(*) FILTER (label_true = label_pred) AS agree FROM a FULL JOIN b ON a.uid = b.uid AND a.x = b.x AND a.y = b.y GROUP BY 1""")
def alignment(spark, sf_dir):
    blob, pk = blob_labels(spark, sf_dir), ["uid", "x", "y"]
    a, b = blob.where("label_true > 0").select(*pk, "label_true"), blob.where("label_pred > 0").select(*pk, "label_pred")
    return a.join(b, pk, "full").groupBy("uid").agg(F.count("*").alias("voxels"), F.count("label_true").alias("in_true"), F.count("label_pred").alias("in_pred"), F.count_if(F.col("label_true") == F.col("label_pred")).alias("agree"))


_BOX = ", ".join(f"coalesce(min({a}) FILTER (label_pred > 0), -1) AS lo_{a}" for a in _AXES) + ", " + ", ".join(f"coalesce(max({a}) FILTER (label_pred > 0) + 1, -1) AS hi_{a}" for a in _AXES)
_RANGE = ", ".join(f"min({a}) FILTER (label_pred > 0) AS lo_{a}" for a in _AXES) + ", " + ", ".join(f"max({a}) FILTER (label_pred > 0) AS hi_{a}" for a in _AXES)


@query("D01_bounding_box", with_(BLOB) + f"SELECT uid, {_BOX} FROM blob GROUP BY uid")
def bounding_box(spark, sf_dir):
    return overlap.bounding_box(blob_labels(spark, sf_dir), blob_headers(spark, sf_dir).select("uid"), "label_pred")


@query("D02_foreground_range", with_(BLOB) + f"SELECT uid, {_RANGE} FROM blob GROUP BY uid")
def foreground_range(spark, sf_dir):
    return overlap.foreground_range(blob_labels(spark, sf_dir), blob_headers(spark, sf_dir).select("uid"), "label_pred")


@query("D03_merged_range", with_(BLOB) + "SELECT uid, " + ", ".join(f"min({a}) FILTER (label_pred > 0 OR label_true > 0) AS lo_{a}, max({a}) FILTER (label_pred > 0 OR label_true > 0) AS hi_{a}" for a in _AXES) + " FROM blob GROUP BY uid")
def merged_range(spark, sf_dir):
    blob, uids = blob_labels(spark, sf_dir), blob_headers(spark, sf_dir).select("uid")
    return overlap.merge_ranges(overlap.foreground_range(blob, uids, "label_pred").unionByName(overlap.foreground_range(blob, uids, "label_true")))


@query("D07_dice_score", SUMS + "SELECT uid, cls, CASE WHEN n_pred + n_true > 0 THEN round(2.0::DOUBLE * inter / (n_pred + n_true), 6) END AS dice FROM s")
def dice_score(spark, sf_dir):
    return blob_sums(spark, sf_dir).select("uid", "cls", six(overlap.dice()).alias("dice"))


@query("D08_iou", SUMS + "SELECT uid, cls, CASE WHEN n_pred + n_true > 0 THEN round(inter::DOUBLE / (n_pred + n_true - inter), 6) END AS iou FROM s")
def iou(spark, sf_dir):
    return blob_sums(spark, sf_dir).select("uid", "cls", six(overlap.iou()).alias("iou"))


@query("D09_stability", with_(LOGITS) + """, c AS (SELECT uid, cls, logit - avg(logit) OVER (PARTITION BY uid, v) AS s FROM logits),
k AS (SELECT uid, cls, count(*) FILTER (s >= 1 AND s >= -1) AS b, count(*) FILTER (s >= 1) AS h, count(*) FILTER (s >= -1) AS l FROM c GROUP BY uid, cls)
SELECT uid, cls, CASE WHEN h + l > 0 THEN round(b::DOUBLE / (h + l - b), 6) END AS stability FROM k""")
def stability(spark, sf_dir):
    found = overlap.stability(emb_logits(spark, sf_dir), ["uid", "v"])
    return found.withColumn("stability", six("stability"))


@query("D10_class_proportion", SUMS + "SELECT uid, cls, round(n_true / 1024.0::DOUBLE, 6) AS true_share, round(n_pred / 1024.0::DOUBLE, 6) AS pred_share FROM s")
def class_proportion(spark, sf_dir):
    return blob_sums(spark, sf_dir).select("uid", "cls", six(overlap.class_proportion("n_true", VOXELS)).alias("true_share"), six(overlap.class_proportion("n_pred", VOXELS)).alias("pred_share"))


@query("D11_class_volume", SUMS + "SELECT uid, cls, round(n_true * s1 * s2 * s3 * 0.001, 6) AS true_ml, round(n_pred * s1 * s2 * s3 * 0.001, 6) AS pred_ml FROM s")
def class_volume(spark, sf_dir):
    s = F.col("spacing")
    return blob_sums(spark, sf_dir).select("uid", "cls", six(overlap.class_volume("n_true", s)).alias("true_ml"), six(overlap.class_volume("n_pred", s)).alias("pred_ml"))


@query("D12_centroid", SUMS + "SELECT uid, cls, " + ", ".join(f"CASE WHEN n_{l} > 0 THEN round({l[0]}_{a}::DOUBLE / n_{l}, 6) END AS {l[0]}c_{a}" for l in ("true", "pred") for a in _AXES) + " FROM s")
def centroid(spark, sf_dir):
    found = blob_sums(spark, sf_dir).select("uid", "cls", *overlap.centroid("t", "n_true"), *overlap.centroid("p", "n_pred"))
    return found.select("uid", "cls", *[six(c).alias(c) for c in found.columns[2:]])


@query("D13_centroid_distance", SUMS + "SELECT uid, cls, CASE WHEN n_true > 0 AND n_pred > 0 THEN round(sqrt(" + " + ".join(f"pow((t_{a}::DOUBLE / n_true - p_{a}::DOUBLE / n_pred) * s{k}, 2)" for k, a in enumerate(_AXES, 1)) + "), 6) END AS distance FROM s")
def centroid_distance(spark, sf_dir):
    return blob_sums(spark, sf_dir).select("uid", "cls", six(overlap.centroid_distance(F.col("spacing"))).alias("distance"))

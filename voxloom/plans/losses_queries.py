"""Queries of losses and image similarity."""

from pyspark.sql import functions as F

from voxloom.catalog import query
from voxloom.functions.nulls import six
from voxloom.operators import losses
from voxloom.plans.fixtures import EMB, LOGITS, emb_images, emb_logits, with_

VOXEL = ["uid", "v"]
TERMS = with_(LOGITS) + """, r AS (SELECT uid, v, cls, logit, (label_true = cls)::INT::DOUBLE AS t, max(logit) OVER (PARTITION BY uid, v) AS top FROM logits),
q AS (SELECT *, logit - top - ln(sum(exp(logit - top)) OVER (PARTITION BY uid, v)) AS lp, 1 / (1 + exp(-logit)) AS sg, least(logit, 0) - ln(1 + exp(-abs(logit))) AS lsp, least(-logit, 0) - ln(1 + exp(-abs(logit))) AS lsn FROM r),
d AS (SELECT uid, cls, CASE WHEN sum(t) > 0 THEN 1 - 2 * sum(exp(lp) * t) / sum(exp(lp) + t) END AS dl, CASE WHEN sum(t) > 0 THEN 1 - 2 * sum(sg * t) / sum(sg + t) END AS dls FROM q GROUP BY uid, cls),
n AS (SELECT uid, sum(-t * lp) / count(DISTINCT v) AS ce, sum(-t * lsp - (1 - t) * lsn) / count(DISTINCT v) AS bce, sum(-pow(1 - exp(lp), 2) * lp * t) / count(DISTINCT v) AS fo,
  sum(-pow(1 - sg, 2) * lsp * t - pow(sg, 2) * lsn * (1 - t)) / count(DISTINCT v) AS bfo FROM q GROUP BY uid)
"""  # fmt: skip


def targets(spark, sf_dir):
    return emb_logits(spark, sf_dir).withColumn("t", (F.col("label_true") == F.col("cls")).cast("double"))


@query("D21_cross_entropy", TERMS + "SELECT uid, round(ce, 6) AS softmax_ce, round(bce, 6) AS sigmoid_ce FROM n")
def cross_entropy(spark, sf_dir):
    rows = targets(spark, sf_dir)
    a = losses.cross_entropy(rows, VOXEL).withColumnRenamed("cross_entropy", "softmax_ce")
    b = losses.cross_entropy(rows, VOXEL, exclusive=False).withColumnRenamed("cross_entropy", "sigmoid_ce")
    return a.join(b, "uid").select("uid", six("softmax_ce").alias("softmax_ce"), six("sigmoid_ce").alias("sigmoid_ce"))


@query("D22_focal_loss", TERMS + "SELECT uid, round(fo, 6) AS softmax_focal, round(bfo, 6) AS sigmoid_focal FROM n")
def focal(spark, sf_dir):
    rows = targets(spark, sf_dir)
    a = losses.focal_loss(rows, VOXEL).withColumnRenamed("focal", "softmax_focal")
    b = losses.focal_loss(rows, VOXEL, exclusive=False).withColumnRenamed("focal", "sigmoid_focal")
    return a.join(b, "uid").select("uid", six("softmax_focal").alias("softmax_focal"), six("sigmoid_focal").alias("sigmoid_focal"))


@query("D23_dice_loss", TERMS + "SELECT uid, cls, round(dl, 6) AS softmax_dice, round(dls, 6) AS sigmoid_dice FROM d")
def dice_loss(spark, sf_dir):
    rows = targets(spark, sf_dir)
    a = losses.dice_loss_by_class(rows, VOXEL).withColumnRenamed("dice_loss", "softmax_dice")
    b = losses.dice_loss_by_class(rows, VOXEL, exclusive=False).withColumnRenamed("dice_loss", "sigmoid_dice")
    return a.join(b, ["uid", "cls"]).select("uid", "cls", six("softmax_dice").alias("softmax_dice"), six("sigmoid_dice").alias("sigmoid_dice"))


@query("D24_segmentation_loss", TERMS + "SELECT uid, round(m.dl + ce + 0.5::DOUBLE * fo, 6) AS loss, round(m.dl, 6) AS dice_loss FROM n JOIN (SELECT uid, avg(dl) FILTER (cls > 0) AS dl FROM d GROUP BY uid) m USING (uid)")
def segmentation_loss(spark, sf_dir):
    found = losses.segmentation_loss(targets(spark, sf_dir), VOXEL, focal=0.5)
    return found.select("uid", six("loss").alias("loss"), six("dice_loss").alias("dice_loss"))


_METRICS = TERMS + """, k AS (SELECT uid, cls, sum(t) AS nt, count(*) AS nv FROM q GROUP BY uid, cls), m AS (SELECT uid, avg(dl) FILTER (cls > 0) AS dl FROM d GROUP BY uid),
every AS (SELECT uid, 'class_' || cls || '_proportion_true' AS metric, nt / nv AS value FROM k UNION ALL SELECT uid, 'class_' || cls || '_volume_true', nt * 0.0015::DOUBLE FROM k UNION ALL SELECT uid, 'dice_loss_class_' || cls, dl FROM d
  UNION ALL SELECT uid, 'dice_loss', dl FROM m UNION ALL SELECT uid, 'cross_entropy_loss', ce FROM n UNION ALL SELECT uid, 'focal_loss', fo FROM n UNION ALL SELECT uid, 'total_loss', m.dl + ce + 0.5::DOUBLE * fo FROM n JOIN m USING (uid))
"""


@query("D24b_loss_metrics", _METRICS + "SELECT uid, metric, round(value, 6) AS value FROM every")
def loss_metrics(spark, sf_dir):
    rows = targets(spark, sf_dir)
    heads = rows.select("uid").distinct().select("uid", F.array(F.lit(1.0), F.lit(0.5), F.lit(3.0)).alias("spacing"))
    return losses.loss_metrics(rows, heads, VOXEL, focal=0.5).withColumn("value", six("value"))


PAIRS = with_(EMB) + ", pairs AS (SELECT a.uid, a.x, a.y, a.value AS a, b.value AS b FROM emb a JOIN emb b ON b.uid = a.uid + 1 AND a.x = b.x AND a.y = b.y), m AS (SELECT uid, avg(pow(a - b, 2)) AS mse, avg(a) AS mean FROM pairs GROUP BY uid)\n"


def pairs(spark, sf_dir):
    a = emb_images(spark, sf_dir)
    b = a.select((F.col("uid") - 1).alias("uid"), "x", "y", "z", "channel", F.col("value").alias("b"))
    return a.withColumnRenamed("value", "a").join(b, ["uid", "x", "y", "z", "channel"])


@query("C11_image_pairs", PAIRS + "SELECT uid, x, y, round(a - b, 6) AS difference FROM pairs")
def image_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("uid", "x", "y", six(F.col("a") - F.col("b")).alias("difference"))


@query("D19_psnr", PAIRS + "SELECT uid, round(20 * log10(2.0::DOUBLE) - 10 * log10(greatest(mse, 1e-5::DOUBLE)), 6) AS psnr FROM m")
def psnr(spark, sf_dir):
    return losses.image_errors(pairs(spark, sf_dir), value_range=2.0).select("uid", six("psnr").alias("psnr"))


@query("D20_nrmsd", PAIRS + "SELECT uid, round(sqrt(mse) / greatest(mean, 1e-5::DOUBLE), 3) AS nrmsd FROM m")
def nrmsd(spark, sf_dir):
    return losses.image_errors(pairs(spark, sf_dir)).select("uid", F.round("nrmsd", 3).alias("nrmsd"))


@query("D25_similarity_losses", PAIRS + "SELECT uid, round(-(20 * log10(2.0::DOUBLE) - 10 * log10(greatest(mse, 1e-5::DOUBLE))), 6) AS psnr_loss, round(sqrt(mse) / greatest(mean, 1e-5::DOUBLE), 3) AS nrmsd_loss FROM m")
def similarity_losses(spark, sf_dir):
    return losses.image_errors(pairs(spark, sf_dir), value_range=2.0).select("uid", six("psnr_loss").alias("psnr_loss"), F.round("nrmsd_loss", 3).alias("nrmsd_loss"))

"""Queries of intensities."""

from pyspark.sql import functions as F

from voxloom.catalog import query
from voxloom.functions import scalar
from voxloom.functions.nulls import six
from voxloom.operators import intensity
from voxloom.plans.fixtures import NOISE, noise_voxels, with_

PC = with_(NOISE) + ", pc AS (SELECT uid, quantile_cont(value::DOUBLE, 0.0095::DOUBLE) AS p0, quantile_cont(value::DOUBLE, 0.995::DOUBLE) AS p1 FROM noise GROUP BY uid)\n"


@query("B13_adjust_gamma", with_(NOISE) + "SELECT uid, x, y, round(1.5::DOUBLE * pow(p_soft, 0.7::DOUBLE), 6) AS value FROM noise")
def gamma(spark, sf_dir):
    return noise_voxels(spark, sf_dir).select("uid", "x", "y", six(scalar.adjust_gamma(F.col("p_soft"), 0.7, 1.5)).alias("value"))


@query("B14_image_cast", with_(NOISE) + "SELECT uid, x, y, round(value::FLOAT::DOUBLE, 3) AS value, label_true FROM noise")
def image_cast(spark, sf_dir):
    """Images become single precision; labels stay as they are."""
    return noise_voxels(spark, sf_dir).select("uid", "x", "y", F.round(F.col("value").cast("float").cast("double"), 3).alias("value"), "label_true")


@query("D04_percentiles", PC + "SELECT uid, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM pc")
def percentiles(spark, sf_dir):
    return intensity.percentiles(noise_voxels(spark, sf_dir)).select("uid", six("p0").alias("p0"), six("p1").alias("p1"))


@query("D05_clip_and_normalise", PC + ", c AS (SELECT n.uid, x, y, least(greatest(value, p0), p1) AS v FROM noise n JOIN pc USING (uid)) SELECT uid, x, y, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS value FROM c WINDOW w AS (PARTITION BY uid)")
def clip_and_normalise(spark, sf_dir):
    return intensity.clip_and_normalise(noise_voxels(spark, sf_dir)).select("uid", "x", "y", six("value").alias("value"))


@query("D06_rescale_intensity", with_(NOISE) + "SELECT uid, x, y, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 2 - 1 END, 6) AS value FROM noise WINDOW w AS (PARTITION BY uid)")
def rescale(spark, sf_dir):
    return intensity.rescale(noise_voxels(spark, sf_dir), ["uid"], -1.0, 1.0).select("uid", "x", "y", six("value").alias("value"))

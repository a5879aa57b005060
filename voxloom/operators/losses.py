"""Losses of stored class scores against labels, and similarity of images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions import scalar
from voxloom.functions.nulls import ratio
from voxloom.operators.overlap import dice_loss, soft_sums


def _mean_over_voxels(rows: DataFrame, term: Column, voxel: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """Sum over a voxel's classes, then mean over voxels, in one shuffle: the rows of one class count the voxels, as each has every class."""
    rows = rows.withColumn("term", term)
    first = F.count(F.when(F.col("cls") == 0, 1))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum("term"), first).alias(name))


def cross_entropy(rows: DataFrame, voxel: Sequence[str], keys: Sequence[str] = ("uid",), exclusive: bool = True) -> DataFrame:
    """rows: dense ``logit`` and target ``t`` by voxel and class. Softmax or summed sigmoid cross entropy."""
    l, t = F.col("logit"), F.col("t")
    term = -t * scalar.log_softmax(l, list(voxel)) if exclusive else -t * scalar.log_sigmoid(l) - (1 - t) * scalar.log_sigmoid(-l)
    return _mean_over_voxels(rows, term, voxel, keys, "cross_entropy")


def focal_loss(rows: DataFrame, voxel: Sequence[str], keys: Sequence[str] = ("uid",), exclusive: bool = True, gamma: float = 2.0) -> DataFrame:
    l, t = F.col("logit"), F.col("t")
    if exclusive:
        log_p = scalar.log_softmax(l, list(voxel))
        term = -F.pow(1 - F.exp(log_p), F.lit(gamma)) * log_p * t
    else:
        p = scalar.sigmoid(l)
        term = -F.pow(1 - p, F.lit(gamma)) * scalar.log_sigmoid(l) * t - F.pow(p, F.lit(gamma)) * scalar.log_sigmoid(-l) * (1 - t)
    return _mean_over_voxels(rows, term, voxel, keys, "focal")


def score_sums(rows: DataFrame, voxel: Sequence[str], keys: Sequence[str] = ("uid", "cls"), exclusive: bool = True) -> DataFrame:
    """Overlap sums of class scores with targets, by class."""
    p = scalar.softmax(F.col("logit"), list(voxel)) if exclusive else scalar.sigmoid(F.col("logit"))
    return soft_sums(rows.withColumn("p", p), keys)


def dice_loss_by_class(rows: DataFrame, voxel: Sequence[str], keys: Sequence[str] = ("uid", "cls"), exclusive: bool = True) -> DataFrame:
    return score_sums(rows, voxel, keys, exclusive).select(*keys, dice_loss().alias("dice_loss"))


def segmentation_loss(rows: DataFrame, voxel: Sequence[str], keys: Sequence[str] = ("uid",), exclusive: bool = True, dice: float = 1.0, cross: float = 1.0, focal: float = 0.0, gamma: float = 2.0) -> DataFrame:
    """Weighted sum of Dice loss over foreground classes that the truth holds, cross entropy and focal loss.

    NULL where the truth has no foreground class and Dice has a weight.
    """
    d = dice_loss_by_class(rows, voxel, [*keys, "cls"], exclusive).groupBy(*keys).agg(F.avg(F.when(F.col("cls") > 0, F.col("dice_loss"))).alias("dice_loss"))
    out = d.join(cross_entropy(rows, voxel, keys, exclusive), list(keys)).join(focal_loss(rows, voxel, keys, exclusive, gamma), list(keys))
    total = cross * F.col("cross_entropy") + focal * F.col("focal")
    return out.withColumn("loss", (dice * F.col("dice_loss") + total) if dice > 0 else total)


def loss_metrics(rows: DataFrame, headers: DataFrame, voxel: Sequence[str], keys: Sequence[str] = ("uid",), exclusive: bool = True, dice: float = 1.0, cross: float = 1.0, focal: float = 0.0, gamma: float = 2.0) -> DataFrame:
    """What goes with :func:`segmentation_loss`, as long ``keys, metric, value``: share and volume of each true class, Dice loss by class
    and on the whole, the other losses that have a weight, and their sum. headers: keys and ``spacing``.
    """
    cls, ml = F.col("cls").cast("string"), F.aggregate("spacing", F.lit(0.001), lambda a, s: a * s)
    true = rows.groupBy(*keys, "cls").agg(F.sum("t").alias("n"), F.count("*").alias("voxels")).join(headers.select(*keys, "spacing"), list(keys))
    named = lambda df, **columns: df.select(*keys, F.inline(F.array(*[F.struct(n.alias("metric"), v.cast("double").alias("value")) for n, v in columns.values()])))
    by_class = named(true, a=(F.concat(F.lit("class_"), cls, F.lit("_proportion_true")), ratio(F.col("n"), F.col("voxels"))), b=(F.concat(F.lit("class_"), cls, F.lit("_volume_true")), F.col("n") * ml))
    whole = segmentation_loss(rows, voxel, keys, exclusive, dice, cross, focal, gamma)
    parts = {"total_loss": "loss"} | ({"dice_loss": "dice_loss"} if dice > 0 else {}) | ({"cross_entropy_loss": "cross_entropy"} if cross > 0 else {}) | ({"focal_loss": "focal"} if focal > 0 else {})
    out = by_class.unionByName(named(whole, **{n: (F.lit(n), F.col(c)) for n, c in parts.items()}))
    if dice > 0:
        out = out.unionByName(named(dice_loss_by_class(rows, voxel, [*keys, "cls"], exclusive), a=(F.concat(F.lit("dice_loss_class_"), cls), F.col("dice_loss"))))
    return out


def image_errors(pairs: DataFrame, keys: Sequence[str] = ("uid",), true: str = "a", pred: str = "b", value_range: float = 1.0, eps: float = scalar.EPS) -> DataFrame:
    """PSNR, NRMSD and their loss forms of aligned values; one pass."""
    sums = pairs.groupBy(*keys).agg(F.avg(F.pow(F.col(true) - F.col(pred), F.lit(2.0))).alias("mse"), F.avg(true).alias("mean"))
    psnr = 20 * F.log10(F.lit(value_range)) - 10 * F.log10(F.greatest("mse", F.lit(eps)))
    nrmsd = ratio(F.sqrt("mse"), F.greatest("mean", F.lit(eps)))
    return sums.select(*keys, psnr.alias("psnr"), nrmsd.alias("nrmsd"), (-psnr).alias("psnr_loss"), nrmsd.alias("nrmsd_loss"))

"""Overlap of predicted and true masks: sums by class from one shuffle, and the metrics that read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.nulls import ratio
from voxloom.functions.tables import joined

AXES = ("x", "y", "z")


def class_grid(uids: DataFrame, classes: int) -> DataFrame:
    """Every class of every volume, so that absent classes have rows."""
    return uids.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))


def overlap_sums(labels: DataFrame, uids: DataFrame, classes: int, keys: Sequence[str] = ("uid",), true: str = "label_true", pred: str = "label_pred") -> DataFrame:
    """``keys, cls, inter, n_pred, n_true`` and coordinate sums ``{t,p}_{x,y,z}`` of aligned hard label rows.

    Voxels are summed by their pair of labels first, and only pairs are dealt to their classes. Voxels without a row count as background
    nowhere: give dense rows if class 0 matters.
    """
    t, p = F.col(true) == F.col("cls"), F.col(pred) == F.col("cls")
    pairs = labels.groupBy(*keys, true, pred).agg(F.count("*").alias("_n"), *[F.sum(a).alias(f"_{a}") for a in AXES])
    rows = pairs.withColumn("cls", F.explode(F.array_distinct(F.array(true, pred))))
    sums = rows.groupBy(*keys, "cls").agg(
        *[F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(n) for n, c in (("inter", t & p), ("n_pred", p), ("n_true", t))],
        *[F.sum(F.when(c, F.col(f"_{a}")).otherwise(0)).cast("long").alias(f"{n}_{a}") for n, c in (("t", t), ("p", p)) for a in AXES],
    )
    return joined(class_grid(uids, classes), sums, [*keys, "cls"], "left").fillna(0)


def stored_overlap(true: DataFrame, pred: DataFrame, keys: Sequence[str] = ("uid",), axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """``keys, cls, inter, n_pred, n_true`` of foreground rows with ``label_true`` and ``label_pred`` in two tables; for tables bucketed by
    the keys nothing is shuffled."""
    sizes = [df.groupBy(*keys, F.col(c).alias("cls")).agg(F.count("*").alias(n)) for df, c, n in ((true, "label_true", "n_true"), (pred, "label_pred", "n_pred"))]
    agree = true.join(pred.hint("merge"), [*keys, *axes]).where("label_true = label_pred").groupBy(*keys, F.col("label_true").alias("cls")).agg(F.count("*").alias("inter"))
    found = sizes[0].join(sizes[1].join(agree.hint("merge"), [*keys, "cls"], "left").hint("merge"), [*keys, "cls"], "full")  # the full join comes last: nothing is partitioned by its keys
    return found.fillna(0, ["inter", "n_pred", "n_true"]).select(*keys, "cls", "inter", "n_pred", "n_true")


def soft_sums(masks: DataFrame, keys: Sequence[str] = ("uid", "cls"), pred: str = "p", true: str = "t") -> DataFrame:
    """``keys, inter, n_pred, n_true`` of mask rows with scores."""
    p, t = F.col(pred).cast("double"), F.col(true).cast("double")
    return masks.groupBy(*keys).agg(F.sum(p * t).alias("inter"), F.sum(p).alias("n_pred"), F.sum(t).alias("n_true"))


def dice(inter: str = "inter", n_pred: str = "n_pred", n_true: str = "n_true") -> Column:
    """Twice the overlap for the sizes; NULL where both masks are empty."""
    return ratio(2 * F.col(inter), F.col(n_pred) + F.col(n_true))


def iou(inter: str = "inter", n_pred: str = "n_pred", n_true: str = "n_true") -> Column:
    return ratio(F.col(inter), F.col(n_pred) + F.col(n_true) - F.col(inter))


def dice_loss(inter: str = "inter", n_pred: str = "n_pred", n_true: str = "n_true") -> Column:
    """One minus Dice; NULL where the true mask is empty."""
    return F.when(F.col(n_true) > 0, 1 - dice(inter, n_pred, n_true))


def stability(logits: DataFrame, voxel: Sequence[str], threshold: float = 0.0, offset: float = 1.0, keys: Sequence[str] = ("uid", "cls")) -> DataFrame:
    """IoU of the masks above ``threshold + offset`` and ``threshold - offset``, scores less their voxel's mean."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    from pyspark.sql import Window

    score = F.col("logit") - F.avg("logit").over(Window.partitionBy(*voxel))
    rows = logits.withColumn("score", score)
    high, low = F.col("score") >= threshold + offset, F.col("score") >= threshold - offset
    return rows.groupBy(*keys).agg(ratio(F.count_if(high & low), F.count_if(high) + F.count_if(low) - F.count_if(high & low)).alias("stability"))


def class_proportion(n: str, voxels: Column | int) -> Column:
    return F.col(n) / (voxels if isinstance(voxels, Column) else F.lit(voxels))


def class_volume(n: str, spacing: Column) -> Column:
    """Millilitres of n voxels."""
    return F.col(n) * F.aggregate(spacing, F.lit(1.0), lambda a, s: a * s) * 0.001


def centroid(prefix: str, n: str) -> list[Column]:
    """Mean coordinates of a mask in voxels; NULL if it is empty."""
    return [ratio(F.col(f"{prefix}_{a}"), F.col(n)).alias(f"{prefix}c_{a}") for a in AXES]


def centroid_distance(spacing: Column) -> Column:
    """Distance of true and predicted centroids; NULL if either mask is empty."""
    parts = [F.pow((ratio(F.col(f"t_{a}"), F.col("n_true")) - ratio(F.col(f"p_{a}"), F.col("n_pred"))) * F.get(spacing, F.lit(k)), F.lit(2.0)) for k, a in enumerate(AXES)]
    return F.sqrt(parts[0] + parts[1] + parts[2])


def bounding_box(voxels: DataFrame, uids: DataFrame, label: str = "label_true", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Smallest and largest-plus-one coordinates of the foreground; -1 throughout where there is none."""
    box = voxels.where(F.col(label) > 0).groupBy(*keys).agg(*[F.min(a).alias(f"lo_{a}") for a in AXES], *[(F.max(a) + 1).alias(f"hi_{a}") for a in AXES])
    return uids.join(box, list(keys), "left").fillna(-1, [f"{e}_{a}" for e in ("lo", "hi") for a in AXES])


def foreground_range(voxels: DataFrame, uids: DataFrame, label: str = "label_true", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Smallest and largest coordinates of the foreground, both inclusive; NULL where there is none."""
    found = voxels.where(F.col(label) != 0).groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES])
    return uids.join(found, list(keys), "left")


def merge_ranges(ranges: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """The range that covers several labels' ranges."""
    return ranges.groupBy(*keys).agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES])

"""Small cases with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from voxloom.functions import scalar
from voxloom.operators import losses, overlap, reports


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_soft_dice_and_iou(spark):
    p, t = [[0.2, 0.3, 0.5], [0.0, 1.0, 0.0]], [2, 1]
    df = spark.createDataFrame([(1, c, p[v][c], float(t[v] == c)) for v in range(2) for c in range(3)], "uid long, cls int, p double, t double")
    found = rows(overlap.soft_sums(df).select("cls", overlap.dice().alias("dice"), overlap.iou().alias("iou")), "cls")
    for c, (d, i) in enumerate(((0, 0), (2 / 2.3, 1 / 1.3), (1 / 1.5, 0.5))):
        assert math.isclose(found[c,].dice, d, abs_tol=1e-9) and math.isclose(found[c,].iou, i, abs_tol=1e-9)


def test_empty_masks_are_undefined(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.5, 0.0)], "uid long, cls int, p double, t double")
    found = rows(overlap.soft_sums(df).select("cls", overlap.dice().alias("dice"), overlap.iou().alias("iou"), overlap.dice_loss().alias("loss")), "cls")
    assert (found[0,].dice, found[0,].iou, found[0,].loss) == (None, None, None)
    assert (found[1,].dice, found[1,].iou, found[1,].loss) == (0.0, 0.0, None)  # the loss is undefined where the truth is empty


def test_a_mask_agrees_with_itself(spark):
    df = spark.createDataFrame([(u, x, y, 0, (x + u) % 3, (x + u) % 3) for u in range(3) for x in range(6) for y in range(5)], "uid long, x int, y int, z int, label_true int, label_pred int")
    uids = spark.range(3).withColumnRenamed("id", "uid")
    for parts in (1, 7):
        found = overlap.overlap_sums(df.repartition(parts), uids, 4).select("uid", "cls", overlap.dice().alias("d")).collect()
        assert {(r.cls, r.d) for r in found} == {(0, 1.0), (1, 1.0), (2, 1.0), (3, None)}


def test_centroids_use_spacing_and_need_both_sides(spark):
    def at(truth, pred):
        df = spark.createDataFrame([(1, x, 0, 0, a, b) for x, (a, b) in enumerate(zip(truth, pred, strict=True))], "uid long, x int, y int, z int, label_true int, label_pred int")
        sums = overlap.overlap_sums(df, spark.createDataFrame([(1,)], "uid long"), 2).withColumn("spacing", F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)))
        return sums.where("cls = 1").select(overlap.centroid_distance(F.col("spacing")).alias("d")).first().d

    assert at([0, 1, 1, 0], [0, 1, 0, 0]) == 1.0 and at([0, 0, 0, 0], [0, 1, 0, 0]) is None


def test_stability_subtracts_the_mean(spark):
    values = [[[0.0, 3.0, 0.0], [3.0, 0.0, 0.0]]]
    for shift in (0.0, 5.0):
        df = spark.createDataFrame([(1, v, c, values[0][v][c] + shift) for v in range(2) for c in range(3)], "uid long, v int, cls int, logit double")
        found = rows(overlap.stability(df, ["uid", "v"]), "cls")
        assert [found[c,].stability for c in range(3)] == [0.5, 0.5, 0.0]
    with pytest.raises(ValueError):
        overlap.stability(df, ["uid", "v"], 0.0, -1.0)


def test_boxes(spark):
    df = spark.createDataFrame([(1, x, 0, 0, v) for x, v in enumerate([0, 1, 0, 1, 0])] + [(2, 0, 0, 0, 0)], "uid long, x int, y int, z int, label int")
    uids = spark.createDataFrame([(1,), (2,)], "uid long")
    box = rows(overlap.bounding_box(df, uids, "label"), "uid")
    assert (box[1,].lo_x, box[1,].hi_x, box[2,].lo_x, box[2,].hi_x) == (1, 4, -1, -1)
    span = rows(overlap.foreground_range(df, uids, "label"), "uid")
    assert (span[1,].lo_x, span[1,].hi_x, span[2,].lo_x) == (1, 3, None)


def test_cross_entropy_and_focal(spark):
    df = spark.createDataFrame([(1, 0, c, x, float(c == 1)) for c, x in enumerate((1.0, 2.0, 3.0))], "uid long, v int, cls int, logit double, t double")
    e = [math.exp(x) for x in (1, 2, 3)]
    p = e[1] / sum(e)
    assert math.isclose(losses.cross_entropy(df, ["uid", "v"]).first().cross_entropy, -math.log(p))
    assert math.isclose(losses.focal_loss(df, ["uid", "v"]).first().focal, -((1 - p) ** 2) * math.log(p))
    s = [1 / (1 + math.exp(-x)) for x in (1, 2, 3)]
    assert math.isclose(losses.cross_entropy(df, ["uid", "v"], exclusive=False).first().cross_entropy, -math.log(1 - s[0]) - math.log(s[1]) - math.log(1 - s[2]))


def test_combined_loss_is_undefined_without_foreground(spark):
    df = spark.createDataFrame([(1, v, c, float(c), float(c == 0)) for v in range(2) for c in range(3)], "uid long, v int, cls int, logit double, t double")
    assert losses.segmentation_loss(df, ["uid", "v"]).first().loss is None
    assert losses.segmentation_loss(df, ["uid", "v"], dice=0.0).first().loss > 0


def test_large_scores_do_not_overflow(spark):
    df = spark.createDataFrame([(1, 0, c, x, float(c == 0)) for c, x in enumerate((900.0, -900.0))], "uid long, v int, cls int, logit double, t double")
    assert losses.cross_entropy(df, ["uid", "v"]).first().cross_entropy == 0.0
    assert losses.cross_entropy(df, ["uid", "v"], exclusive=False).first().cross_entropy == 0.0


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (4,)], "l int").select(scalar.nested_label(F.col("l")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 2, 1, 3]
    with pytest.raises(ValueError):
        scalar.previous_t_index(F.col("t"), 5, "last")


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "d", 1.0), (2, "d", None), (3, "d", 3.0)], "uid long, metric string, value double")
    assert {r.metric: r.value for r in reports.aggregate_metrics(df).collect()} == {"mean_d": 2.0, "min_d": 1.0, "max_d": 3.0}
    parts = spark.createDataFrame([("min_d", 1.0), ("min_d", 2.0), ("max_d", 1.0), ("max_d", 2.0), ("mean_d", 1.0), ("mean_d", 4.0)], "metric string, value double")
    assert {r.metric: r.value for r in reports.merge_aggregates(parts).collect()} == {"min_d": 1.0, "max_d": 2.0, "mean_d": 2.5}
    with pytest.raises(ValueError):
        reports.evaluate(df, df, 2, 1, ["x"], label_pred=False)

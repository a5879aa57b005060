import math

import pytest
from pyspark.sql import functions as F

from voxloom.operators import catalogue


def numbers(spark, n, group="a"):
    return spark.createDataFrame([(k, group) for k in range(n)], "i int, g string")


def splits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.split, []).append(r.i)
    return {k: sorted(v) for k, v in out.items()}


def test_group_splits_overlap_when_small(spark):
    for n in (1, 3, 5, 8, 20):
        end = int(0.75 * n) - 2
        want = {"valid": list(range(n))[:2], "train": list(range(n))[2:end], "test": list(range(n))[end:]}
        assert splits(catalogue.split_by_group(numbers(spark, n), "g", "i")) == {k: v for k, v in want.items() if v}, n


def test_ratio_and_count_splits(spark):
    assert splits(catalogue.split_by_ratio(numbers(spark, 25), "i"))["valid"] == [0, 1]
    assert splits(catalogue.split_by_count(numbers(spark, 9), "i", 5, 2)) == {"train": [0, 1, 2, 3, 4], "valid": [5, 6], "test": [7, 8]}


def test_paths(spark):
    df = spark.createDataFrame([("a/amos_0500.nii.gz",), ("b/amos_0501.nii.gz",)], "path string")
    assert [r.u for r in df.select(catalogue.path_to_uid(F.col("path")).alias("u")).collect()] == ["0500", "0501"]
    assert catalogue.keep_modality(df).count() == 1  # 500 itself is kept


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2, "x")), 3)], "a struct<b:int,c:struct<d:int,e:string>>, f int")
    assert catalogue.flatten(df).columns == ["a_b", "a_c_d", "a_c_e", "f"]


def test_modalities_and_pairs(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (3, "a")], "uid int, modality string")
    assert sorted(r.uid for r in catalogue.complete_uids(files, 2).collect()) == [1, 3]
    assert sorted(r.uid for r in catalogue.intersect_uids([files.where(F.col("modality") == m).select("uid") for m in "ab"]).collect()) == [1, 3]
    assert catalogue.pair_images(files.select("uid").distinct(), spark.createDataFrame([(2,), (9,)], "uid int")).first().uid == 2


def test_geometry(spark):
    kinds = "uid int, shape array<int>, spacing array<double>"
    a = spark.createDataFrame([(1, [2, 2], [1.0, 1.0]), (2, [2, 2], [1.0, 1.0]), (3, [2, 2], [1.0, 1.0]), (4, [2, 2], [100.0, 1.0])], kinds)
    b = spark.createDataFrame([(1, [2, 2], [1.0005, 1.0]), (2, [2, 3], [1.0, 1.0]), (3, [2, 2], [1.0, 1.01]), (4, [2, 2], [100.0019, 1.0])], kinds)
    assert {(r.uid, r.field) for r in catalogue.geometry_violations(a, b, ["spacing"]).collect()} == {(2, "shape"), (3, "spacing")}


def test_batches(spark):
    assert catalogue.batches(numbers(spark, 10), "i", 4, True).count() == 8
    whole = catalogue.batches(numbers(spark, 10), "i", 4, False)
    padded = catalogue.pad_batches(whole.withColumn("uid", F.col("i").cast("string")), "batch_id", "slot", 4, ["i"])
    assert padded.count() == 12 and padded.where("padded").count() == 2
    with pytest.raises(Exception, match="not full"):
        catalogue.pad_batches(whole, "batch_id", "slot", 4, ["i"], training=True).collect()
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "c")], "b int, s int, uid string")
    assert sorted(r.uid for r in catalogue.unpad(rows, "b", "s", "uid").collect()) == ["a", "c"]


def test_checkpoints(spark):
    rows = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.7), (1, 30, 0.7), (1, 40, math.nan), (1, 50, None)], "run int, step int, value double")
    assert catalogue.best_checkpoint(rows).first().step == 20  # the smallest step wins ties
    assert catalogue.best_checkpoint(rows, largest=False).first().step == 10
    assert sorted(r.step for r in catalogue.newest(rows, 2).collect()) == [40, 50]


def test_early_stopping(spark):
    values = [0.1, 0.5, 0.52, 0.51, 0.4, 0.9]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "run int, step int, value double")
    assert catalogue.early_stop(rows, 3, 0.05).first().stop_step == 4
    assert catalogue.early_stop(rows, 3, 0.0).first().stop_step is None
    assert catalogue.early_stop(rows.withColumn("value", -F.col("value")), 3, 0.05, largest=False).first().stop_step == 4


def test_shuffle_does_not_depend_on_partitions(spark):
    one = [r.i for r in catalogue.shuffled(numbers(spark, 50).repartition(1), "i", 3).collect()]
    assert one == [r.i for r in catalogue.shuffled(numbers(spark, 50).repartition(9), "i", 3).collect()] != sorted(one)
    assert one != [r.i for r in catalogue.shuffled(numbers(spark, 50), "i", 4).collect()]


def test_later_families_win(spark):
    a = spark.createDataFrame([(1, "m", 1.0), (1, "n", 2.0)], "uid int, metric string, value double")
    b = spark.createDataFrame([(1, "m", 5.0)], "uid int, metric string, value double")
    assert {r.metric: r.value for r in catalogue.merge_families([a, b], ["uid", "metric"]).collect()} == {"m": 5.0, "n": 2.0}


def test_intersection_of_many_types(spark, tmp_path):
    """Key 1 has all of 60 types, every other key lacks one."""
    from voxloom.catalog import QUERIES

    rows = [(u, f"t{k}") for u in range(1, 61) for k in range(60) if u == 1 or k != u - 1]
    spark.createDataFrame(rows, "user_id long, event_type string").selectExpr("*", "timestamp '2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.user_id for r in QUERIES["G01_intersect"](spark, str(tmp_path)).collect()] == [1]

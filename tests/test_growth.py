"""What keeps work in proportion to large tables: tasks, joins, passes and state."""

import random
import time

import pytest
from pyspark.sql import functions as F

from voxloom.functions.scalar import keyed_uniform, shared_uniform
from voxloom.operators import grids, intensity, morphology, overlap, reports
from voxloom.plans.fixtures import blob_labels, us_masks
from voxloom.sources import volumes
from voxloom.streaming import history

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tables_are_made_in_many_tasks(spark):
    for made in (blob_labels(spark, SF), us_masks(spark, SF)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert plan(made.groupBy("uid", "x").count()).count("Exchange") == 1  # the one that deals them out


def test_exploded_tables_are_not_broadcast(spark):
    blob = blob_labels(spark, SF)
    heads = blob.select("uid").distinct()
    assert "Broadcast" not in plan(overlap.overlap_sums(blob, heads, 4))
    cleaned = morphology.clean_predictions(us_masks(spark, SF).where("uid < 3"), (64, 48))
    assert "Broadcast" not in plan(cleaned)


def test_sums_by_pairs_of_labels(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), x, y, 0, draw.choice([None, 0, 1, 2]), draw.choice([None, 0, 1, 2])) for x in range(6) for y in range(5)]
    df = spark.createDataFrame(rows, "uid string, x int, y int, z int, label_true int, label_pred int")
    got = {(r.uid, r.cls): r for r in overlap.overlap_sums(df, spark.createDataFrame([("a",), ("b",), ("c",)], "uid string"), 4).collect()}
    assert len(got) == 12
    for (uid, cls), r in got.items():
        t, p = ([q for q in rows if q[0] == uid and q[k] == cls] for k in (4, 5))
        assert (r.inter, r.n_true, r.n_pred) == (sum(q in p for q in t), len(t), len(p))
        assert (r.t_x, r.t_y, r.p_x, r.p_y) == (sum(q[1] for q in t), sum(q[2] for q in t), sum(q[1] for q in p), sum(q[2] for q in p))


def test_small_files_are_read_by_many_tasks_in_few_batches(spark, tmp_path):
    for k in range(1200):
        (tmp_path / f"v{k}.nii").write_bytes(volumes.make_header((2, 2, 1), 1, (1, 1, 1), (0, 0, 0), (1, 0, 0, 0, 1, 0, 0, 0, 1), 16) + bytes([0, 0, 0, 0] * 4))
    reader = volumes.VolumeReader({"path": f"file://{tmp_path}", "block": "1,1,1"})
    parts = reader.partitions()
    assert len(parts) >= 3 and sum(len(p.pieces) for p in parts) == 1200
    batches = list(reader.read(parts[0]))
    assert sum(b.num_rows for b in batches) == 4 * len(parts[0].pieces) and len(batches) <= 3
    assert volumes.read_volumes(spark, f"file://{tmp_path}", (1, 1, 1)).count() == 4800


def test_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).selectExpr("id AS uid", "0 AS x", "0 AS y", "0.5D AS value")
    volumes.write_grey_images(rows, f"file://{tmp_path}/i")
    tracker = spark.sparkContext.statusTracker()
    tasks = [s.numTasks for j in tracker.getJobIdsForGroup(None) for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i))]
    assert tasks[-1] > 1 or max(tasks) > 1
    for bad in ([(0, 1), (0, 1)], [(1, 1)], [(0, 1), (2, 1)]):  # a pixel twice, the first one or one between missing
        with pytest.raises(Exception, match="missing or repeated"):
            volumes.write_grey_images(spark.createDataFrame([("g", x, 0, 0.5) for x, _ in bad], "uid string, x int, y int, value double"), f"file://{tmp_path}/b")


def test_large_and_sparse_tiles(spark):
    full = spark.range(64**3).selectExpr("1L AS uid", "cast(id div 4096 AS int) AS x", "cast(id div 64 % 64 AS int) AS y", "cast(id % 64 AS int) AS z", "cast(id AS float) AS value")
    began = time.perf_counter()
    assert list(grids.to_tiles(full, (64, 64, 64), ["x", "y", "z"]).first().data) == [float(k) for k in range(64**3)]
    assert time.perf_counter() - began < 60  # as a map it took the square of the tile's voxels
    few = spark.createDataFrame([(1, 5, 2, 7.0), (1, 9, 0, None), (2, 0, 0, 1.0)], "uid long, x int, y int, value double")
    got = {(r.uid, r.ox, r.oy): list(r.data) for r in grids.to_tiles(few, (3, 3), ["x", "y"]).collect()}
    none = [None] * 9
    assert got == {(1, 3, 0): [*none[:8], 7.0], (1, 9, 0): none, (2, 0, 0): [1.0, *none[1:]]}
    with pytest.raises(Exception, match="given twice"):
        grids.to_tiles(few.unionByName(few), (3, 3), ["x", "y"]).collect()


def test_voxels_are_made_once_for_percentiles_and_scaling(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    for f in (intensity.clip_and_normalise, lambda d: intensity.rescale(d, ["uid"])):
        made.value = 0
        rows = spark.range(100).selectExpr("id % 3 AS uid", "id AS x", "cast(id AS double) AS value").mapInArrow(counted, "uid long, x long, value double")
        assert f(rows).count() == 100 and f(rows).where("value BETWEEN 0 AND 1").count() == 100
        assert made.value == 200


def test_shared_draws_are_the_keyed_ones(spark):
    df = spark.createDataFrame([(k // 7 if k % 5 else None, f"n{k % 3}") for k in range(50)], "a long, b string")
    both = df.select(*[f(7, "n", *keys).alias(f"{n}{len(keys)}") for n, f in (("k", keyed_uniform), ("s", shared_uniform)) for keys in (("a",), ("a", "b"))])
    assert all(r.k1 == r.s1 and r.k2 == r.s2 for r in both.collect())


def test_scores_side_by_side(spark):
    draw = random.Random(5)
    rows = [(u, x, c, draw.uniform(-3, 3)) for u in "ab" for x in range(20) for c in (0, 1, 5) if draw.random() < 0.8] + [("a", 20, 0, 1.0), ("a", 20, 1, 1.0), ("b", 21, 5, None)]
    df, voxel = spark.createDataFrame(rows, "uid string, x int, cls int, logit double"), ["uid", "x"]
    wide = reports.class_columns(df, voxel, [0, 1, 5])
    told = lambda t: {(r.uid, r.metric): r.value for r in t.collect()}
    assert told(reports.confidence_of_columns(wide, [0, 1, 5])) == told(reports.confidence_report(df, voxel))
    assert {tuple(r) for r in reports.largest_column(wide, voxel, [0, 1, 5]).collect()} == {tuple(r) for r in reports.largest_class(df, voxel).collect()}
    with pytest.raises(Exception, match="given twice"):
        reports.class_columns(df.unionByName(df), voxel, [0, 1, 5]).collect()


def test_stops_of_runs_in_one_bucket(spark, tmp_path):
    """Runs that share a bucket's state, over arrivals that are folded in between, against a plain loop."""
    draw = random.Random(1)
    rows = [(run, step, draw.random()) for run in range(9) for step in range(0, 60, run + 1)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == k], "run long, step long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = history.early_stops(spark.readStream.schema("run long, step long, value double").parquet(f"{tmp_path}/in"), 3, 0.05, late=5, buckets=1)
        found = history.run_to_end(stream, f"file://{tmp_path}", "update")
    got = {r.run: tuple(r.s) for r in found.groupBy("run").agg(F.max_by(F.struct("n", "stop_step", "best"), "n").alias("s")).collect()}
    for run in range(9):
        values, best, wait, stop = [(s, v) for r, s, v in rows if r == run], None, 0, None
        for s, v in values:
            if stop is None:
                better = best is None or v - best > 0.05
                best, wait = (v, 0) if better else (best, wait + 1)
                stop = s if wait >= 3 else None
        assert got[run] == (len(values), stop, best)

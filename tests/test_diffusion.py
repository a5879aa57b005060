import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from voxloom.operators import diffusion, randoms
from voxloom.streaming import history


def betas(spark, steps, kind, **options):
    return [r.beta for r in diffusion.beta_schedule(spark, steps, kind, **options).orderBy("t_index").collect()]


def test_schedules(spark):
    assert betas(spark, 3, "linear", start=0.1, end=0.3) == pytest.approx([0.1, 0.2, 0.3])
    assert betas(spark, 3, "quadradic", start=0.01, end=0.09) == pytest.approx([0.01, 0.04, 0.09])
    assert betas(spark, 20, "warmup10", start=0.01, end=0.04) == pytest.approx([0.01, 0.04] + [0.04] * 18)
    f = lambda t: math.cos((t + 0.008) / 1.008 * math.pi / 2) ** 2
    assert betas(spark, 3, "cosine", start=0.0, end=1.0) == pytest.approx([0.0, 1 - f(0.5), 1 - f(1.0)])  # always from the start
    assert betas(spark, 1, "linear") == [1e-4]
    with pytest.raises(ValueError):
        betas(spark, 3, "quadratic")


def test_downsampling_keeps_the_ends(spark):
    for steps, keep in ((21, 5), (101, 5), (11, 3)):
        whole = diffusion.beta_schedule(spark, steps)
        cut = diffusion.downsample(whole, steps, keep)
        ends = [diffusion.schedule(b).orderBy("t_index").select("alpha_cumprod").collect() for b in (whole, cut)]
        assert len(ends[1]) == keep
        for k in (0, -1):
            assert math.isclose(ends[0][k][0], ends[1][k][0], rel_tol=1e-9)
    with pytest.raises(ValueError):
        diffusion.downsample(diffusion.beta_schedule(spark, 10), 10, 5)


def test_noise_and_start_are_inverse(spark):
    s = diffusion.schedule(diffusion.beta_schedule(spark, 10))
    rows = diffusion.at_step(spark.range(10).select(F.col("id").cast("int").alias("t_index"), F.lit(0.3).alias("x0"), F.lit(-0.7).alias("e")), s)
    xt = diffusion.q_sample(F.col("x0"), F.col("e"))
    got = rows.select(diffusion.x_start_from_noise(xt, F.col("e")).alias("a"), diffusion.noise_from_x_start(xt, F.col("x0")).alias("b")).collect()
    assert all(math.isclose(r.a, 0.3, abs_tol=1e-9) and math.isclose(r.b, -0.7, abs_tol=1e-6) for r in got)
    with pytest.raises(ValueError):
        diffusion.predicted_noise(F.col("x"), F.col("x"), "other")
    with pytest.raises(ValueError):
        diffusion.model_log_variance("learned")


def test_a_perfect_model_has_no_divergence(spark):
    s = diffusion.schedule(diffusion.beta_schedule(spark, 10))
    rows = diffusion.at_step(spark.range(1, 10).select(F.col("id").alias("uid"), F.col("id").cast("int").alias("t_index"), F.lit(0.3).alias("x0"), F.lit(-0.7).alias("e")), s)
    rows = rows.withColumn("xt", diffusion.q_sample(F.col("x0"), F.col("e")))
    for r in diffusion.variational_bound(rows, "x0", "x0", "xt", variance="fixed_small").collect():
        assert abs(r.vlb) < 1e-9 and r.noise_mse == 0


def test_probabilities(spark):
    rows = spark.createDataFrame([(k, n, h) for k, (n, h) in enumerate(zip((4, 6, 5, 10), (9.0, 4.0, 0.0, 0.0), strict=True))], "t_index int, n long, loss_sq double")
    found = {r.t_index: r for r in diffusion.step_probabilities(rows).collect()}
    assert [found[k].p_loss for k in range(4)] == pytest.approx([0.5965, 0.3985, 0.0025, 0.0025])
    assert [found[k].p_count for k in range(4)] == pytest.approx([6 / 15, 4 / 15, 5 / 15, 0])
    none = rows.withColumn("loss_sq", F.lit(0.0)).withColumn("n", F.lit(99).cast("long"))
    assert {(r.p_loss, r.p_count) for r in diffusion.step_probabilities(none).collect()} == {(0.25, 0.25)}


EVENTS = [(0, 0, 1, 2.0), (0, 1, 1, 3.0), (0, 2, 2, 1.0), (1, 0, 1, 1.0), (2, 0, 2, 4.0), (2, 1, 2, 2.0)]


def folded():
    n, h = {}, {}
    for b in range(3):
        last = {}
        for batch, _, t, loss in EVENTS:
            if batch == b:
                last[t] = loss
                n[t] = n.get(t, 0) + 1
        for t, loss in last.items():
            h[t] = 0.1 * loss * loss + 0.9 * h.get(t, 0.0)
    return {t: (n[t], h[t]) for t in n}


def test_loss_history(spark):
    df = spark.createDataFrame(EVENTS, "batch_id long, pos int, t_index int, loss double")
    got = {r.t_index: (r.n, r.loss_sq) for r in diffusion.loss_history(df, 4).collect()}
    assert got[0] == got[3] == (0, 0)
    for t, (n, h) in folded().items():
        assert got[t][0] == n and math.isclose(got[t][1], h)


def arrivals(spark, at, parts, schema):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{at}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")


LOSS_ROWS = "batch_id long, pos int, t_index int, loss double"


def test_loss_history_stream_with_split_batches(spark, tmp_path):
    """Batches go on in later arrivals and come out of order, in time and across restarts."""
    orders = [(EVENTS[:1], EVENTS[1:4], EVENTS[4:5], EVENTS[5:]), (EVENTS[5:], EVENTS[2:4], EVENTS[:2], EVENTS[4:5])]
    for n, parts in enumerate(orders):
        at = f"file://{tmp_path}/{n}"
        rows = history.run_to_end(history.loss_history(arrivals(spark, at, parts, LOSS_ROWS)), at, "update")
        last = rows.groupBy("t_index").agg(F.max_by(F.struct("n", "loss_sq"), "n").alias("r")).select("t_index", "r.*").collect()
        assert {r.t_index for r in last} == set(folded())
        for r in last:
            n_rows, h = folded()[r.t_index]
            assert r.n == n_rows and math.isclose(r.loss_sq, h)


def test_late_batches_are_dropped_and_others_folded(spark, tmp_path):
    """What waits is folded as the watermark passes: the history stays exact, and a batch beyond the bound no longer counts."""
    at = f"file://{tmp_path}"
    parts = [[(b, 0, 1, float(b % 7))] for b in (0, 3, 2, 1, 40, 38, 80, 79, 120, 5, 119)]
    stream = history.loss_history(arrivals(spark, at, parts, LOSS_ROWS), late=10)
    rows = history.run_to_end(stream, at, "update")
    kept = sorted(b for ((b, *_),) in parts if b != 5)  # 5 came after 120
    want = 0.0
    for b in kept:
        want = 0.9 * want + 0.1 * float(b % 7) ** 2
    last = rows.orderBy(F.desc("n")).first()
    assert last.n == len(kept) and math.isclose(last.loss_sq, want)


def test_early_stop_stream(spark, tmp_path):
    values = [(1, k, v) for k, v in enumerate((0.1, 0.5, 0.52, 0.51, 0.4, 0.9))]
    for n, parts in enumerate(([[*values, (2, 0, 1.0)]], [values[3:], [(2, 0, 1.0)], values[1:3], values[:1]])):
        at = f"file://{tmp_path}/{n}"
        rows = history.run_to_end(history.early_stops(arrivals(spark, at, parts, "run long, step long, value double"), 3, 0.05), at, "update")
        got = {r.run: (r.n, r.stop_step, r.best) for r in rows.groupBy("run").agg(F.max("n").alias("n"), F.max_by(F.struct("stop_step", "best"), "n").alias("r")).select("run", "n", "r.*").collect()}
        assert got == {1: (6, 4, 0.5), 2: (1, None, 1.0)}


def test_ingest_of_repeated_scans(spark, tmp_path):
    """A tile sent again, in its arrival, a later one or after a restart, is there once; so is what a failed commit repeats."""
    at, schema = f"file://{tmp_path}", "uid long, ox int, data array<double>, sent timestamp"
    day = lambda d: datetime.datetime(2024, 1, d)
    first = [(1, 0, [1.0], day(1)), (1, 0, [1.0], day(1)), (1, 8, [2.0], day(1))]
    again = [(1, 0, [1.0], day(2)), (2, 0, [3.0], day(2))]
    run = lambda: history.ingest(history.new_tiles(spark, f"{at}/in", schema, options={"recursiveFileLookup": "true"}), at, ["uid", "ox"], "sent", "3 days")
    for k, part in enumerate((first, again)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{at}/in/{k}")
        got = run()
    assert sorted((r.uid, r.ox) for r in got.collect()) == [(1, 0), (1, 8), (2, 0)] and run().count() == 3
    newest = max(p for p in os.listdir(f"{tmp_path}/checkpoint/commits") if p.isdigit())
    for name in (newest, f".{newest}.crc"):  # as if it had failed after writing
        os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    assert sorted((r.uid, r.ox) for r in run().collect()) == [(1, 0), (1, 8), (2, 0)]
    spark.createDataFrame([(3, 0, [4.0], day(20))], schema).coalesce(1).write.parquet(f"{at}/in/9")
    assert run().where("uid = 3").count() == 1


def test_random_columns(spark):
    df = spark.range(20_000)
    u = df.select(randoms.uniform(1, "u", F.col("id")).alias("u"), randoms.normal(1, "n", F.col("id")).alias("n"), randoms.around(0.5, 0.3, 1, 1, "a", F.col("id")).alias("a"))
    r = u.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev("n"), F.avg((F.col("a") != 1).cast("int")), F.min("a"), F.max("a")).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03
    assert abs(r[5] - 0.3) < 0.02 and r[6] >= 0.5 and r[7] <= 1.5
    pair = df.limit(9).select("id", randoms.uniform(1, "u", F.col("id")).alias("u"))
    assert sorted(pair.repartition(1).collect()) == sorted(pair.repartition(5).collect())


def test_step_sampling(spark):
    rows = spark.createDataFrame([(k, 100, float(k)) for k in range(6)], "t_index int, n long, loss_sq double")
    samples = spark.range(6000).withColumnRenamed("id", "uid")
    got = randoms.sample_steps(samples, rows, 6, 1, 4, 7)
    assert got.count() == 6000 and {r.t_index for r in got.select("t_index").distinct().collect()} == {1, 2, 3}
    told = {r.t_index: r.p for r in got.select("t_index", "p").distinct().collect()}
    whole = {r.t_index: r.p_loss for r in diffusion.step_probabilities(rows).collect()}
    assert all(math.isclose(told[t], whole[t]) for t in told)  # not renormalised to the range
    share = {r.t_index: r["count"] / 6000 for r in got.groupBy("t_index").count().collect()}
    for t in share:
        assert abs(share[t] - whole[t] / sum(whole[k] for k in (1, 2, 3))) < 0.03
    cold = rows.withColumn("n", F.when(F.col("t_index") == 2, 3).otherwise(50).cast("long"))
    assert {(r.t_index, r.p) for r in randoms.sample_steps(samples, cold, 6, 1, 4, 7, warmup=10).select("t_index", "p").distinct().collect()} == {(2, 1 / 6)}
    for low, high in ((-1, 3), (3, 3), (0, 7)):
        with pytest.raises(ValueError):
            randoms.sample_steps(samples, rows, 6, low, high, 1)

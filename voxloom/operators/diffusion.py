"""Diffusion tables: schedules, noising, scoring of stored model outputs, timestep statistics.

A schedule has one row per timestep, a few thousand at most by nature, and is broadcast under that stated bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.functions import scalar
from voxloom.functions.nulls import ratio

#: Most timesteps that a schedule may have; longer ones are refused, so that broadcasting one stays cheap.
MOST_STEPS = 100_000


def _linspace(a: float, b: float, n: int, i: Column) -> Column:
    return F.lit(a) + i * ((b - a) / (n - 1)) if n > 1 else F.lit(a)


def beta_schedule(spark: SparkSession, steps: int, kind: str = "linear", start: float = 1e-4, end: float = 0.02) -> DataFrame:
    """``t_index, beta``. kinds: linear, quadradic (spelt so), cosine, warmup10, warmup50.

    The cosine kind measures every step from the start: beta is one minus the squared cosine, rescaled.
    """
    if steps > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} steps")
    i = F.col("t_index")
    root = lambda n: F.pow(_linspace(start**0.5, end**0.5, n, i), F.lit(2.0))
    if kind == "linear":
        beta = _linspace(start, end, steps, i)
    elif kind == "quadradic":
        beta = root(steps)
    elif kind == "cosine":
        angle = (i / max(steps - 1, 1) + 0.008) / 1.008 * (math.pi / 2)
        beta = F.when(i == 0, 0.0).otherwise(1 - F.pow(F.cos(angle), F.lit(2.0))) * (end - start) + start
    elif kind in ("warmup10", "warmup50"):
        warm = max(steps // (10 if kind == "warmup10" else 2), 1)
        beta = F.when(i < warm, root(warm)).otherwise(end)
    else:
        raise ValueError(f"unknown schedule {kind}")
    return spark.range(steps).select(F.col("id").cast("int").alias("t_index")).select("t_index", beta.cast("double").alias("beta"))


def _alphas(betas: DataFrame) -> DataFrame:
    return betas.withColumn("alpha_cumprod", F.product(1 - F.col("beta")).over(Window.orderBy("t_index")))


def downsample(betas: DataFrame, steps: int, keep: int) -> DataFrame:
    """Every k-th cumulative product kept, ends included, and the betas that give them."""
    if keep > steps or keep < 1 or (keep > 1 and (steps - 1) % (keep - 1) != 0) or (keep == 1 and steps != 1):
        raise ValueError("steps to keep must divide the schedule evenly")
    if keep == steps:
        return betas
    every = (steps - 1) // (keep - 1)
    kept = _alphas(betas).where(F.col("t_index") % every == 0).withColumn("t_index", (F.col("t_index") / every).cast("int"))
    return kept.select("t_index", (1 - F.col("alpha_cumprod") / F.lag("alpha_cumprod", 1, 1.0).over(Window.orderBy("t_index"))).alias("beta"))


def schedule(betas: DataFrame) -> DataFrame:
    """The derived columns of a schedule; undefined values are NULL."""
    w = Window.orderBy("t_index")
    rows = _alphas(betas).withColumn("alpha_cumprod_prev", F.lag("alpha_cumprod", 1, 1.0).over(w)).withColumn("alpha_cumprod_next", F.lead("alpha_cumprod", 1, 0.0).over(w))
    b, a, prev = F.col("beta"), F.col("alpha_cumprod"), F.col("alpha_cumprod_prev")
    rows = rows.withColumns({
        "sqrt_alpha_cumprod": F.sqrt(a), "sqrt_one_minus_alpha_cumprod": F.sqrt(1 - a), "log_one_minus_alpha_cumprod": F.log(1 - a),
        "sqrt_recip_alpha_cumprod": F.sqrt(ratio(F.lit(1.0), a)), "sqrt_recip_alpha_cumprod_minus_one": F.sqrt(ratio(F.lit(1.0), a) - 1),
        "posterior_mean_coeff_start": ratio(b * F.sqrt(prev), 1 - a), "posterior_mean_coeff_t": ratio(F.sqrt(1 - b) * (1 - prev), 1 - a), "posterior_variance": ratio(b * (1 - prev), 1 - a),
    })
    v = F.col("posterior_variance")
    clipped = F.when(F.col("t_index") == 0, F.lead("posterior_variance").over(w)).otherwise(v)
    large = F.when(F.col("t_index") == 0, F.lead("posterior_variance").over(w)).otherwise(b)
    return rows.withColumn("posterior_log_variance_clipped", F.log(clipped)).withColumn("fixed_large_log_variance", F.log(large))


def at_step(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the schedule's columns of their ``t_index``."""
    return rows.join(F.broadcast(table), "t_index")


def q_sample(x_start: Column, noise: Column) -> Column:
    return F.col("sqrt_alpha_cumprod") * x_start + F.col("sqrt_one_minus_alpha_cumprod") * noise


def noised(rows: DataFrame, table: DataFrame, x_start: str, seed: int, keys: Sequence[str], noise: Callable[..., Column] | None = None) -> DataFrame:
    """Rows at their ``t_index`` with ``noise`` and ``x_t`` added. noise: any function of a seed and key columns; standard normal by default."""
    draw = noise or (lambda s, *k: scalar.keyed_normal(s, "noise", *k))
    found = at_step(rows, table).withColumn("noise", draw(seed, *map(F.col, keys)))
    return found.withColumn("x_t", q_sample(F.col(x_start), F.col("noise")))


def q_mean_log_variance(x_start: Column) -> tuple[Column, Column]:
    return F.col("sqrt_alpha_cumprod") * x_start, F.col("log_one_minus_alpha_cumprod")


def q_posterior(x_start: Column, x_t: Column) -> tuple[Column, Column, Column]:
    """Mean, variance and clipped log variance of the step before, given the start and the step."""
    return F.col("posterior_mean_coeff_start") * x_start + F.col("posterior_mean_coeff_t") * x_t, F.col("posterior_variance"), F.col("posterior_log_variance_clipped")


def x_start_from_noise(x_t: Column, noise: Column) -> Column:
    return F.col("sqrt_recip_alpha_cumprod") * x_t - F.col("sqrt_recip_alpha_cumprod_minus_one") * noise


def noise_from_x_start(x_t: Column, x_start: Column) -> Column:
    return ratio(F.col("sqrt_recip_alpha_cumprod") * x_t - x_start, F.col("sqrt_recip_alpha_cumprod_minus_one"))


def predicted_x_start(out: Column, x_t: Column, kind: str) -> Column:
    """The start that a model's output stands for; kind: ``x_start`` (clipped) or ``noise``."""
    if kind == "x_start":
        return F.greatest(F.least(out, F.lit(1.0)), F.lit(-1.0))
    if kind == "noise":
        return x_start_from_noise(x_t, out)
    raise ValueError(f"unknown output {kind}")


def predicted_noise(out: Column, x_t: Column, kind: str) -> Column:
    if kind == "noise":
        return out
    if kind == "x_start":
        return noise_from_x_start(x_t, predicted_x_start(out, x_t, kind))
    raise ValueError(f"unknown output {kind}")


def model_log_variance(kind: str, second: Column | None = None) -> Column:
    """By type: fixed_small, fixed_large, learned (the output's second half), learned_range (between two bounds, by its sigmoid)."""
    if kind == "fixed_small":
        return F.col("posterior_log_variance_clipped")
    if kind == "fixed_large":
        return F.col("fixed_large_log_variance")
    if second is None:
        raise ValueError("a learned variance needs the second half of the output")
    if kind == "learned":
        return second
    if kind == "learned_range":
        share = scalar.sigmoid(second)
        return share * F.log("beta") + (1 - share) * F.col("posterior_log_variance_clipped")
    raise ValueError(f"unknown variance {kind}")


def variational_bound(rows: DataFrame, out: str, x_start: str, x_t: str, kind: str = "x_start", variance: str = "fixed_large", keys: tuple[str, ...] = ("uid",), second: str | None = None) -> DataFrame:
    """Bits per value of stored outputs (rows already joined with a schedule), and mean square error of the noise.

    Above step 0 the divergence of the two posteriors; at step 0 the likelihood of the start under q's own mean and variance.
    """
    x0, xt = F.col(x_start), F.col(x_t)
    q_mean, _, q_log = q_posterior(x0, xt)
    p_mean = q_posterior(predicted_x_start(F.col(out), xt, kind), xt)[0]
    kl = scalar.normal_kl(q_mean, q_log, p_mean, model_log_variance(variance, F.col(second) if second else None))
    nll = -scalar.discretized_log_likelihood(x0, q_mean, q_log)
    error = F.pow(predicted_noise(F.col(out), xt, kind) - noise_from_x_start(xt, x0), F.lit(2.0))
    return rows.groupBy(*keys, "t_index").agg((F.avg(F.when(F.col("t_index") == 0, nll).otherwise(kl)) / math.log(2.0)).alias("vlb"), F.avg(error).alias("noise_mse"))


def step_probabilities(history: DataFrame, uniform: float = 0.01, warmup: int = 10) -> DataFrame:
    """``history(t_index, n, loss_sq)`` with ``p_loss`` and ``p_count``, one row per timestep.

    p_loss: roots of the averages, made to sum to one, mixed with ``uniform`` of evenness; p_count: what each step lacks of ``warmup`` rows.
    """
    every, lack, root = Window.partitionBy(), F.greatest(F.lit(warmup) - F.col("n"), F.lit(0)), F.sqrt("loss_sq")
    even = 1.0 / F.count("*").over(every)
    by_loss = F.coalesce(ratio(root, F.sum(root).over(every)), even)
    return history.withColumn("p_loss", by_loss * (1 - uniform) + uniform * even).withColumn("p_count", F.coalesce(ratio(lack, F.sum(lack).over(every)), even))


def loss_history(events: DataFrame, steps: int, decay: float = 0.9) -> DataFrame:
    """``t_index, n, loss_sq`` after all batches in order: the moving average takes the last row of a batch, the count all.

    A batch changes the average once, from its value before the batch: (1 - decay) loss^2 + decay average, from 0.
    """
    last = events.groupBy("t_index", "batch_id").agg(F.max_by("loss", "pos").alias("loss"), F.count("*").alias("k"))
    later = F.row_number().over(Window.partitionBy("t_index").orderBy(F.desc("batch_id"))) - 1
    terms = last.withColumn("term", (1 - decay) * F.pow(F.lit(decay), later) * F.col("loss") * F.col("loss"))
    sums = terms.groupBy("t_index").agg(F.sum("k").alias("n"), F.sum("term").alias("loss_sq"))
    every = events.sparkSession.range(steps).select(F.col("id").cast("int").alias("t_index"))
    return every.join(sums, "t_index", "left").fillna(0, ["n", "loss_sq"])


def history_statistics(history: DataFrame) -> DataFrame:
    """Entropy of the loss-based probabilities, and statistics of counts and averages, in one row."""
    p = step_probabilities(history)
    return p.agg(
        (-F.sum(F.col("p_loss") * F.log("p_loss"))).alias("entropy"), F.avg("n").alias("mean_count"), F.median("n").alias("median_count"), F.min("n").alias("min_count"), F.max("n").alias("max_count"),
        F.avg("loss_sq").alias("mean_loss_sq"), F.min("loss_sq").alias("min_loss_sq"), F.max("loss_sq").alias("max_loss_sq"),
    )


def weighted_loss(losses: DataFrame, probabilities: DataFrame, steps: int, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Mean of loss times probability times the number of steps."""
    rows = losses.join(F.broadcast(probabilities.select("t_index", "p_loss")), "t_index")
    return rows.groupBy(*keys).agg(F.avg(F.col("loss") * F.col("p_loss") * steps).alias("loss"))

"""Queries of diffusion tables. Stored outputs stand on the vectors' images, with a timestep for each."""

from pyspark.sql import functions as F

from voxloom.catalog import query
from voxloom.functions import scalar
from voxloom.functions.nulls import six
from voxloom.operators import diffusion
from voxloom.plans.fixtures import EMB, LOSSES, STEPS, emb_images, loss_events, uniform_sql, with_

T = 50
#: The schedule that the tables' timesteps index; its last step is the number of distinct timesteps of the data.
BETAS = "b AS (SELECT t::INT AS t_index, 1e-4::DOUBLE + t * ((0.02::DOUBLE - 1e-4::DOUBLE) / 49) AS beta FROM range(0, 50) r(t))"
SCHEDULE = BETAS + """, a1 AS (SELECT *, product(1 - beta) OVER (ORDER BY t_index) AS ac FROM b), a2 AS (SELECT *, lag(ac, 1, 1.0::DOUBLE) OVER (ORDER BY t_index) AS pv, lead(ac, 1, 0.0::DOUBLE) OVER (ORDER BY t_index) AS nx FROM a1),
a3 AS (SELECT *, beta * sqrt(pv) / (1 - ac) AS c0, sqrt(1 - beta) * (1 - pv) / (1 - ac) AS ct, beta * (1 - pv) / (1 - ac) AS v FROM a2),
sch AS (SELECT *, ln(CASE WHEN t_index = 0 THEN lead(v) OVER (ORDER BY t_index) ELSE v END) AS lv, ln(CASE WHEN t_index = 0 THEN lead(v) OVER (ORDER BY t_index) ELSE beta END) AS lvl FROM a3)"""
ROWS = with_(EMB, SCHEDULE) + """, r AS (SELECT uid, x, y, (uid % 50)::INT AS t_index, greatest(least(value * 4, 1), -1) AS x0, value * 7 - 0.1::DOUBLE AS noise, value * 3 + 0.05::DOUBLE AS out FROM emb),
q AS (SELECT r.*, sch.*, sqrt(ac) * x0 + sqrt(1 - ac) * noise AS xt FROM r JOIN sch USING (t_index))
"""


def table(spark, kind="linear"):
    return diffusion.schedule(diffusion.beta_schedule(spark, T, kind))


def outputs(spark, sf_dir):
    v = F.col("value")
    rows = emb_images(spark, sf_dir).select("uid", "x", "y", (F.col("uid") % T).cast("int").alias("t_index"), F.greatest(F.least(v * 4, F.lit(1.0)), F.lit(-1.0)).alias("x0"), (v * 7 - 0.1).alias("noise"), (v * 3 + 0.05).alias("out"))
    return diffusion.at_step(rows, table(spark)).withColumn("xt", diffusion.q_sample(F.col("x0"), F.col("noise")))


def show(df, *columns):
    return df.select("uid", "x", "y", *[six(c).alias(n) for n, c in columns])


@query("B15_time", with_(EMB) + "SELECT uid, x, y, round(((uid % 50) + 1) / 50.0::DOUBLE, 6) AS t FROM emb")
def time(spark, sf_dir):
    return show(emb_images(spark, sf_dir), ("t", scalar.t_index_to_t(F.col("uid") % T, T)))


@query("B16_previous_step", with_(LOSSES) + "SELECT batch_id, pos, 49 AS by_max, t_index + 1 AS by_next, t_index AS by_same FROM losses")
def previous_step(spark, sf_dir):
    t = F.col("t_index")
    return loss_events(spark, sf_dir).select("batch_id", "pos", *[scalar.previous_t_index(t, STEPS, m).alias(f"by_{m}") for m in ("max", "next", "same")])


@query("C08_schedule_lookup", ROWS + "SELECT uid, x, y, t_index, round(ac, 6) AS alpha_cumprod FROM q")
def lookup(spark, sf_dir):
    return outputs(spark, sf_dir).select("uid", "x", "y", "t_index", six("alpha_cumprod").alias("alpha_cumprod"))


def used(spark, sf_dir, frame):
    """A schedule's rows with how many values of the data are at each."""
    n = emb_images(spark, sf_dir).groupBy((F.col("uid") % T).cast("int").alias("t_index")).agg(F.count("*").alias("n"))
    return frame.join(n, "t_index")


@query("E09_schedule", with_(EMB, SCHEDULE) + "SELECT t_index, count(*) AS n, " + ", ".join(f"round(any_value({e}), 6) AS {n}" for n, e in (("alpha_cumprod", "ac"), ("next", "nx"), ("coeff_start", "c0"), ("coeff_t", "ct"), ("variance", "v"), ("log_variance", "lv"))) + " FROM emb JOIN sch ON sch.t_index = uid % 50 GROUP BY t_index")
def schedule(spark, sf_dir):
    names = {"alpha_cumprod": "alpha_cumprod", "next": "alpha_cumprod_next", "coeff_start": "posterior_mean_coeff_start", "coeff_t": "posterior_mean_coeff_t", "variance": "posterior_variance", "log_variance": "posterior_log_variance_clipped"}
    return used(spark, sf_dir, table(spark)).select("t_index", "n", *[six(c).alias(n) for n, c in names.items()])


_KINDS = {
    "linear": "1e-4::DOUBLE + t * ((0.02::DOUBLE - 1e-4::DOUBLE) / 49)", "quadradic": "pow(sqrt(1e-4::DOUBLE) + t * ((sqrt(0.02::DOUBLE) - sqrt(1e-4::DOUBLE)) / 49), 2)",
    "cosine": "CASE WHEN t = 0 THEN 0 ELSE 1 - pow(cos((t / 49.0::DOUBLE + 0.008::DOUBLE) / 1.008::DOUBLE * (pi() / 2)), 2) END * (0.02::DOUBLE - 1e-4::DOUBLE) + 1e-4::DOUBLE",
    "warmup10": "CASE WHEN t < 5 THEN pow(sqrt(1e-4::DOUBLE) + t * ((sqrt(0.02::DOUBLE) - sqrt(1e-4::DOUBLE)) / 4), 2) ELSE 0.02::DOUBLE END",
    "warmup50": "CASE WHEN t < 25 THEN pow(sqrt(1e-4::DOUBLE) + t * ((sqrt(0.02::DOUBLE) - sqrt(1e-4::DOUBLE)) / 24), 2) ELSE 0.02::DOUBLE END",
}


@query("E10_beta_schedules", with_(EMB) + "SELECT t AS t_index, n, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _KINDS.items()) + " FROM (SELECT (uid % 50)::INT AS t, count(*) AS n FROM emb GROUP BY 1)")
def betas(spark, sf_dir):
    from functools import reduce

    tables = [diffusion.beta_schedule(spark, T, k).select("t_index", six("beta").alias(k)) for k in _KINDS]
    return used(spark, sf_dir, reduce(lambda a, b: a.join(b, "t_index"), tables))


@query("E11_downsampled_schedule", with_(EMB, SCHEDULE) + ", k AS (SELECT (t_index // 7)::INT AS t_index, ac FROM sch WHERE t_index % 7 = 0), m AS (SELECT t_index, 1 - ac / lag(ac, 1, 1.0::DOUBLE) OVER (ORDER BY t_index) AS beta FROM k), e2 AS (SELECT (uid % 50)::INT AS t_index, count(*) AS n FROM emb GROUP BY 1) SELECT t_index, round(beta, 6) AS beta, n FROM m JOIN e2 USING (t_index)")
def downsampled(spark, sf_dir):
    found = diffusion.downsample(diffusion.beta_schedule(spark, T), T, 8)
    return used(spark, sf_dir, found).select("t_index", six("beta").alias("beta"), "n")


@query("D37_forward_noising", ROWS + "SELECT uid, x, y, round(xt, 6) AS xt, round(sqrt(ac) * x0, 6) AS mean, round(ln(1 - ac), 6) AS log_variance FROM q")
def noising(spark, sf_dir):
    mean, log = diffusion.q_mean_log_variance(F.col("x0"))
    return show(outputs(spark, sf_dir), ("xt", F.col("xt")), ("mean", mean), ("log_variance", log))


_DRAW = uniform_sql(7, "noise", "uid || '|' || x || '|' || y")


@query("U5_noise_function", ROWS + f", u AS (SELECT uid, x, y, ac, x0, 2 * {_DRAW} - 1 AS e FROM q) SELECT uid, x, y, round(e, 6) AS noise, round(sqrt(ac) * x0 + sqrt(1 - ac) * e, 6) AS x_t FROM u")
def noise_function(spark, sf_dir):
    """Noise from a function that the caller gives: uniform on [-1, 1)."""
    rows = outputs(spark, sf_dir).select("uid", "x", "y", "t_index", "x0")
    found = diffusion.noised(rows, table(spark), "x0", 7, ["uid", "x", "y"], lambda seed, *keys: 2 * scalar.keyed_uniform(seed, "noise", *keys) - 1)
    return show(found, ("noise", F.col("noise")), ("x_t", F.col("x_t")))


@query("D38_posterior", ROWS + "SELECT uid, x, y, round(c0 * x0 + ct * xt, 6) AS mean, round(v, 6) AS variance, round(lv, 6) AS log_variance FROM q")
def posterior(spark, sf_dir):
    mean, var, log = diffusion.q_posterior(F.col("x0"), F.col("xt"))
    return show(outputs(spark, sf_dir), ("mean", mean), ("variance", var), ("log_variance", log))


@query("D39_start_and_noise", ROWS + "SELECT uid, x, y, round(sqrt(1 / ac) * xt - sqrt(1 / ac - 1) * out, 6) AS x_start, round((sqrt(1 / ac) * xt - greatest(least(out, 1), -1)) / sqrt(1 / ac - 1), 6) AS noise FROM q")
def start_and_noise(spark, sf_dir):
    out, xt = F.col("out"), F.col("xt")
    return show(outputs(spark, sf_dir), ("x_start", diffusion.predicted_x_start(out, xt, "noise")), ("noise", diffusion.predicted_noise(out, xt, "x_start")))


@query("D40_model_variance", ROWS + "SELECT uid, x, y, round(lv, 6) AS small, round(lvl, 6) AS large, round(noise, 6) AS learned, round(1 / (1 + exp(-noise)) * ln(beta) + (1 - 1 / (1 + exp(-noise))) * lv, 6) AS learned_range FROM q")
def variance(spark, sf_dir):
    kinds = {"small": "fixed_small", "large": "fixed_large", "learned": "learned", "learned_range": "learned_range"}
    return show(outputs(spark, sf_dir), *[(n, diffusion.model_log_variance(k, F.col("noise"))) for n, k in kinds.items()])


_CDF = "0.5 * (1 + tanh(sqrt(2 / pi()) * (({0}) + 0.044715::DOUBLE * pow({0}, 3))))"
_UP, _DOWN = _CDF.format("exp(-0.5 * lv) * (x0 - qm + 1 / 255.0::DOUBLE)"), _CDF.format("exp(-0.5 * lv) * (x0 - qm - 1 / 255.0::DOUBLE)")
BOUND = ROWS.rstrip() + f""", u AS (SELECT *, c0 * x0 + ct * xt AS qm, c0 * greatest(least(out, 1), -1) + ct * xt AS pm FROM q),
w AS (SELECT *, 0.5 * (-1 + lvl - lv + exp(lv - lvl) + pow(qm - pm, 2) * exp(-lvl)) AS kl, -CASE WHEN x0 < -0.999 THEN ln(greatest({_UP}, 1e-12::DOUBLE)) WHEN x0 > 0.999 THEN ln(greatest(1 - {_DOWN}, 1e-12::DOUBLE)) ELSE ln(greatest({_UP} - {_DOWN}, 1e-12::DOUBLE)) END AS nll FROM u)
"""


@query("D41_variational_bound", BOUND + "SELECT uid, t_index, round(avg(CASE WHEN t_index = 0 THEN nll ELSE kl END) / ln(2), 4) AS vlb, round(avg(pow((sqrt(1 / ac) * xt - greatest(least(out, 1), -1)) / sqrt(1 / ac - 1) - (sqrt(1 / ac) * xt - x0) / sqrt(1 / ac - 1), 2)), 4) AS noise_mse FROM w GROUP BY uid, t_index")
def bound(spark, sf_dir):
    found = diffusion.variational_bound(outputs(spark, sf_dir), "out", "x0", "xt")
    return found.select("uid", "t_index", F.round("vlb", 4).alias("vlb"), F.round("noise_mse", 4).alias("noise_mse"))


@query("S1_normal_kl", ROWS + "SELECT uid, x, y, round(0.5 * (-1 + lvl - lv + exp(lv - lvl) + pow(x0 - out, 2) * exp(-lvl)), 3) AS kl FROM q WHERE t_index > 0")
def normal_kl(spark, sf_dir):
    kl = scalar.normal_kl(F.col("x0"), F.col("posterior_log_variance_clipped"), F.col("out"), F.col("fixed_large_log_variance"))
    return outputs(spark, sf_dir).where("t_index > 0").select("uid", "x", "y", F.round(kl, 3).alias("kl"))


@query("S2_normal_cdf", ROWS + f"SELECT uid, x, y, round({_CDF.format('noise')}, 6) AS cdf FROM q")
def normal_cdf(spark, sf_dir):
    return show(outputs(spark, sf_dir), ("cdf", scalar.approx_normal_cdf(F.col("noise"))))


@query("S3_discretized_likelihood", BOUND + "SELECT uid, x, y, round(-nll, 4) + 0.0::DOUBLE AS likelihood FROM w")
def likelihood(spark, sf_dir):
    mean, _, log = diffusion.q_posterior(F.col("x0"), F.col("xt"))
    return outputs(spark, sf_dir).select("uid", "x", "y", (F.round(scalar.discretized_log_likelihood(F.col("x0"), mean, log), 4) + F.lit(0.0)).alias("likelihood"))


HISTORY = with_(LOSSES) + """, l AS (SELECT t_index, batch_id, arg_max(loss, pos) AS loss, count(*) AS k FROM losses GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY t_index ORDER BY batch_id DESC) - 1 AS later FROM l),
h AS (SELECT t_index, sum(k)::BIGINT AS n, sum((1 - 0.9::DOUBLE) * pow(0.9::DOUBLE, later) * loss * loss) AS loss_sq FROM o GROUP BY t_index),
hist AS (SELECT g.t_index::INT AS t_index, coalesce(n, 0) AS n, coalesce(loss_sq, 0) AS loss_sq FROM range(0, 50) g(t_index) LEFT JOIN h USING (t_index)),
prob AS (SELECT *, CASE WHEN sum(sqrt(loss_sq)) OVER () > 0 THEN sqrt(loss_sq) / sum(sqrt(loss_sq)) OVER () ELSE 1.0::DOUBLE / 50 END * 0.99::DOUBLE + 0.01::DOUBLE / 50 AS p_loss,
  CASE WHEN sum(greatest(200 - n, 0)) OVER () > 0 THEN greatest(200 - n, 0)::DOUBLE / sum(greatest(200 - n, 0)) OVER () ELSE 1.0::DOUBLE / 50 END AS p_count FROM hist)
"""


def history(spark, sf_dir):
    return diffusion.loss_history(loss_events(spark, sf_dir), STEPS)


@query("J01_loss_history", HISTORY + "SELECT t_index, n, round(loss_sq, 6) AS loss_sq FROM hist")
def loss_history(spark, sf_dir):
    return history(spark, sf_dir).withColumn("loss_sq", six("loss_sq"))


@query("D42_step_probabilities", HISTORY + "SELECT t_index, round(p_loss, 6) AS p_loss, round(p_count, 6) AS p_count FROM prob")
def probabilities(spark, sf_dir):
    found = diffusion.step_probabilities(history(spark, sf_dir), warmup=200)
    return found.select("t_index", six("p_loss").alias("p_loss"), six("p_count").alias("p_count"))


@query("D36_history_statistics", HISTORY + "SELECT round(-sum(p_loss * ln(p_loss)), 6) AS entropy, round(avg(n), 6) AS mean_count, round(median(n), 6) AS median_count, min(n) AS min_count, max(n) AS max_count, round(avg(loss_sq), 6) AS mean_loss_sq, round(min(loss_sq), 6) AS min_loss_sq, round(max(loss_sq), 6) AS max_loss_sq FROM prob")
def statistics(spark, sf_dir):
    found = diffusion.history_statistics(history(spark, sf_dir))
    return found.select(*[c if c in ("min_count", "max_count") else six(c).alias(c) for c in found.columns])


@query("D43_weighted_loss", HISTORY + "SELECT batch_id, round(avg(loss * p_loss * 50), 6) AS loss FROM losses JOIN prob USING (t_index) GROUP BY batch_id")
def weighted_loss(spark, sf_dir):
    p = diffusion.step_probabilities(history(spark, sf_dir))
    return diffusion.weighted_loss(loss_events(spark, sf_dir), p, STEPS).withColumn("loss", six("loss"))

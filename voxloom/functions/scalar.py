"""Column functions over voxels, class scores and timesteps."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, Window, functions as F
from pyspark.sql.types import DoubleType

EPS = 1e-5


def nested_label(label: Column) -> Column:
    """Exclusive to nested tumour labels: 4 becomes 3, 1 becomes 2, other positive ones 1."""
    return F.when(label == 4, 3).when(label == 1, 2).when(label >= 1, 1).otherwise(0)


def softmax(logit: Column, voxel: list[str]) -> Column:
    """Softmax over the rows of a voxel's classes."""
    w = Window.partitionBy(*voxel)
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def log_softmax(logit: Column, voxel: list[str]) -> Column:
    w = Window.partitionBy(*voxel)
    top = F.max(logit).over(w)
    return logit - top - F.log(F.sum(F.exp(logit - top)).over(w))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Stable: min(x, 0) - ln(1 + exp(-|x|))."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def smooth_label(mask: Column, classes: int, exclusive: bool, smoothing: float) -> Column:
    """Towards an even score: 1/classes if classes exclude each other, else a half. For dense class rows."""
    return mask * (1 - smoothing) + smoothing * (1.0 / classes if exclusive else 0.5)


def mask_to_x(mask: Column) -> Column:
    return mask * 2.0 - 1.0


def x_to_mask(x: Column) -> Column:
    return (F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) + 1.0) / 2.0


def x_to_logits(x: Column) -> Column:
    return F.log(F.greatest(F.least((x + 1.0) / 2.0, F.lit(1.0)), F.lit(EPS)))


def adjust_gamma(value: Column, gamma: Column | float, gain: float = 1.0) -> Column:
    return gain * F.pow(value, gamma if isinstance(gamma, Column) else F.lit(gamma))


def t_index_to_t(t_index: Column, steps: int) -> Column:
    return (t_index + 1) / F.lit(float(steps))


def previous_t_index(t_index: Column, steps: int, mode: str) -> Column:
    """The step before it in paired sampling: the last one, the next one up, or itself."""
    if mode == "max":
        return F.lit(steps - 1)
    if mode == "next":
        return t_index + 1
    if mode == "same":
        return t_index
    raise ValueError(f"unknown mode {mode}")


def normal_kl(mean1: Column, log_var1: Column, mean2: Column, log_var2: Column) -> Column:
    """KL divergence of two normals, from means and log variances."""
    return 0.5 * (-1.0 + log_var2 - log_var1 + F.exp(log_var1 - log_var2) + F.pow(mean1 - mean2, F.lit(2.0)) * F.exp(-log_var2))


def approx_normal_cdf(x: Column) -> Column:
    """The tanh approximation of the standard normal's distribution function."""
    return 0.5 * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (x + 0.044715 * F.pow(x, F.lit(3.0)))))


def discretized_log_likelihood(x: Column, mean: Column, log_var: Column, delta: float = 1 / 255, bound: float = 0.999, least: float = 1e-12) -> Column:
    """Log-likelihood of x in [-1, 1] under a normal, over the bin x - delta to x + delta, open at the ends."""
    inv = F.exp(-0.5 * log_var)
    up, down = approx_normal_cdf(inv * (x - mean + delta)), approx_normal_cdf(inv * (x - mean - delta))
    low = F.lit(least)
    return F.when(x < -bound, F.log(F.greatest(up, low))).when(x > bound, F.log(F.greatest(1.0 - down, low))).otherwise(F.log(F.greatest(up - down, low)))


def keyed_uniform(seed: int, name: str, *keys: Column | str) -> Column:
    """On [0, 1), with 52 bits of the MD5 of ``seed|name|key|...``: any engine can draw the same numbers. NULL keys are left out of the text."""
    return F.conv(F.substring(F.md5(_keyed(seed, name, keys).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _keyed(seed: int, name: str, keys: Sequence[Column | str]) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])


def shared_uniform(seed: int, name: str, *keys: Column | str) -> Column:
    """The numbers of :func:`keyed_uniform` for keys that many rows share, such as a volume's: drawn once for each key of an Arrow batch."""
    return _drawn(_keyed(seed, name, keys))


@F.arrow_udf(DoubleType())
def _drawn(text: pa.Array) -> pa.Array:
    found = text.dictionary_encode()
    drawn = [int(hashlib.md5(t.encode()).hexdigest()[:13], 16) / (1 << 52) for t in found.dictionary.to_pylist()]
    return pa.array(drawn, pa.float64()).take(found.indices)


def keyed_normal(seed: int, name: str, *keys: Column | str) -> Column:
    """Standard normal, from two uniform draws."""
    a, b = keyed_uniform(seed, f"{name}/a", *keys), keyed_uniform(seed, f"{name}/b", *keys)
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(2 * math.pi * b)

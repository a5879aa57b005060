"""Stencils along the axes of voxel tables: gradients, smoothing, edges, structural similarity.

One pass per axis, as a window over that axis's lines; columns that need the same axis are computed together. Three
border rules are told apart by name: ``replicate``, ``zero`` and ``drop``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.groups import whole_groups

#: A tile's side, rows that are taken together, and cells of one array.
TILE, ROWS, CELLS = 64, 1 << 16, 1 << 21

AXES = ("x", "y", "z")


def line(axis: str, axes: Sequence[str], keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)


def central_difference(v: Column, window, spacing: Column | float = 1.0) -> Column:
    """(next - previous) / 2 / spacing; a border cell stands in for its missing neighbour."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    return (F.coalesce(F.lead(v).over(window), v) - F.coalesce(F.lag(v).over(window), v)) / 2 / s


def gradient(voxels: DataFrame, values: Sequence[str], axes: Sequence[str], spacing: dict[str, float] | None = None, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """``voxels`` with a column ``{value}_d{axis}`` for every value and axis."""
    for a in axes:
        w = line(a, axes, keys)
        voxels = voxels.withColumns({f"{v}_d{a}": central_difference(F.col(v), w, (spacing or {}).get(a, 1.0)) for v in values})
    return voxels


def jacobian_determinant(ddf: DataFrame, components: Sequence[str], axes: Sequence[str], spacing: dict[str, float] | None = None, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Determinant of the identity plus the field's gradient, in 2 or 3 dimensions, as ``det``."""
    g = gradient(ddf, components, axes, spacing, keys)
    m = [[F.col(f"{c}_d{a}") + (1.0 if i == j else 0.0) for j, a in enumerate(axes)] for i, c in enumerate(components)]
    if len(axes) == 2:
        det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    elif len(axes) == 3:
        det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    else:
        raise ValueError("two or three axes")
    return g.withColumn("det", det)


def deformation_losses(ddf: DataFrame, components: Sequence[str], axes: Sequence[str], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Mean absolute and square gradient, bending energy, and mean folding of a deformation field."""
    first = jacobian_determinant(ddf, components, axes, keys=keys)
    names = [f"{c}_d{a}" for c in components for a in axes]
    second = gradient(first, names, axes, keys=keys)
    twice = [f"{n}_d{a}" for n in names for a in axes]
    mean = lambda terms: F.avg(sum(terms, F.lit(0.0)) / len(terms))
    return second.groupBy(*keys).agg(
        mean([F.abs(F.col(n)) for n in names]).alias("gradient_l1"), mean([F.col(n) * F.col(n) for n in names]).alias("gradient_l2"),
        mean([F.col(n) * F.col(n) for n in twice]).alias("bending"), F.avg(F.greatest(-F.col("det"), F.lit(0.0))).alias("folding"),
    )


def gaussian(sigma: float, size: int) -> list[float]:
    """Normalised Gaussian weights at size places around the middle."""
    w = [math.exp(-(((k - (size - 1) / 2) / sigma) ** 2) / 2) for k in range(size)]
    return [x / sum(w) for x in w]


def uniform(size: int) -> list[float]:
    return [1.0 / size] * size


def convolve(voxels: DataFrame, values: Sequence[str], weights: Sequence[float], axes: Sequence[str], border: str = "zero", keys: Sequence[str] = ("uid",), odd_only: bool = False) -> DataFrame:
    """Separable convolution of ``values``; a voxel that is absent counts as 0. border: ``zero`` pads, ``drop`` keeps only windows all of whose voxels are there.

    Tiles are dealt out with the rims that their windows reach: one shuffle whatever the number of axes.

    odd_only: reject even kernels, which are off centre by half a voxel.
    """
    size = len(weights)
    if size < 2 or border not in ("zero", "drop") or (odd_only and size % 2 == 0):
        raise ValueError("kernel size or border")
    before = (size - 1) // 2
    tiles = [f"_t_{a}" for a in axes]
    rows = voxels.withColumns({v: F.col(v).cast("double") for v in values})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for a, t in zip(axes, tiles, strict=True):  # a voxel goes to every tile with a place that its window reaches
        rows = rows.withColumn(t, F.explode(F.sequence(F.floor((F.col(a) - (size - 1 - before)) / TILE), F.floor((F.col(a) + before) / TILE))))
    rows = rows.repartition(*keys, *tiles).sortWithinPartitions(*keys, *tiles)
    return rows.mapInArrow(_convolved(list(keys), list(axes), tiles, list(values), list(weights), before, border == "drop"), kinds)


def _convolved(keys: list[str], axes: list[str], tiles: list[str], values: list[str], weights: list[float], before: int, drop: bool):
    """Rows of tiles with their rims, sorted by tile, to the tiles' own rows with their values convolved; tiles of a batch are one array."""
    size = len(weights)

    def windows(dense: np.ndarray, join) -> np.ndarray:
        for k in range(1, dense.ndim):
            dense = join(np.take(dense, range(n, dense.shape[k] - size + 1 + n), k) for n in range(size))
        return dense

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, numbers in whole_groups(batches, [*keys, *tiles], ROWS):
            place = np.column_stack([whole.column(a).to_numpy() - whole.column(t).to_numpy() * TILE for a, t in zip(axes, tiles, strict=True)])
            home = ((place >= 0) & (place < TILE)).all(axis=1)
            used = np.isin(numbers, numbers[home])  # a tile may hold nothing but another one's rim
            if not used.any():
                continue
            whole, place, home = whole.filter(pa.array(used)), place[used], home[used]
            numbers = np.unique(numbers[used], return_inverse=True)[1]
            place = place - place.min(axis=0)
            shape = place.max(axis=0) + size
            step = max(1, CELLS // int(np.prod(shape)))
            for g in range(0, int(numbers[-1]) + 1, step):
                i, j = np.searchsorted(numbers, g), np.searchsorted(numbers, g + step)
                spot = (numbers[i:j] - g, *(place[i:j] + before).T)
                own = np.nonzero(home[i:j])[0] + i
                tiles_here = int(numbers[j - 1]) - g + 1
                if drop:
                    there = np.zeros((tiles_here, *shape), bool)
                    there[spot] = True
                    own = own[windows(there, lambda parts: reduce(np.logical_and, parts))[(numbers[own] - g, *place[own].T)]]
                out = whole.take(pa.array(own, pa.int64()))
                for v in values:
                    dense = np.zeros((tiles_here, *shape))
                    dense[spot] = whole.column(v).to_numpy()[i:j]
                    dense = windows(dense, lambda parts: sum(w * p for w, p in zip(weights, parts, strict=True)))
                    found = dense[(numbers[own] - g, *place[own].T)]
                    out = out.set_column(out.column_names.index(v), v, pa.array(found, pa.float64(), mask=np.isnan(found)))
                yield from out.drop_columns(tiles).combine_chunks().to_batches()

    return run


def smooth_labels(masks: DataFrame, axes: Sequence[str], sigma: float, size: int, exclusive: bool, keys: Sequence[str] = ("uid",), voxel: Sequence[str] = ("uid", "x", "y", "z")) -> DataFrame:
    """Gaussian smoothing of dense class rows ``p``; scores of exclusive classes are made to sum to one."""
    out = convolve(masks, ["p"], gaussian(sigma, size), axes, "zero", [*keys, "cls"])
    return out.withColumn("p", F.try_divide("p", F.sum("p").over(Window.partitionBy(*voxel)))) if exclusive else out


def mask_edges(voxels: DataFrame, mask: str, axes: Sequence[str] = AXES, keys: Sequence[str] = ("uid", "cls")) -> DataFrame:
    """Foreground rows with a neighbour along an axis that is not foreground; outside of the volume nothing is.

    Rows may be sparse: a neighbour is the next row of the line if its coordinate is the next one.
    """
    rows = voxels.where(F.col(mask)) if mask else voxels
    inside = F.lit(True)
    for a in axes:
        w = line(a, axes, keys)
        rows = rows.withColumn(f"_in_{a}", F.coalesce(F.lead(a).over(w) == F.col(a) + 1, F.lit(False)) & F.coalesce(F.lag(a).over(w) == F.col(a) - 1, F.lit(False)))
        inside = inside & F.col(f"_in_{a}")
    return rows.where(~inside).drop(*[f"_in_{a}" for a in axes])


def ssim(pairs: DataFrame, axes: Sequence[str], max_val: float, sigma: float = 1.5, size: int = 11, kernel: str = "gaussian", k1: float = 0.01, k2: float = 0.03, keys: Sequence[str] = ("uid",), channel: str = "channel") -> DataFrame:
    """Mean structural similarity of aligned values ``a`` and ``b`` over whole windows and channels."""
    weights = gaussian(sigma, size) if kernel == "gaussian" else uniform(size)
    five = pairs.withColumns({"a2": F.col("a") * F.col("a"), "b2": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    c = convolve(five, ["a", "b", "a2", "b2", "ab"], weights, axes, "drop", [*keys, channel])
    a, b = F.col("a"), F.col("b")
    va, vb, cov = F.col("a2") - a * a, F.col("b2") - b * b, F.col("ab") - a * b
    c1, c2 = (k1 * max_val) ** 2, (k2 * max_val) ** 2
    score = ((2 * a * b + c1) * (2 * cov + c2)) / ((a * a + b * b + c1) * (va + vb + c2))
    return c.groupBy(*keys).agg(F.avg(score).alias("ssim"))

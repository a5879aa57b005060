"""Coordinate grids, patches, crops, pads, flips and tiles. Only headers are looked at to plan; voxels move by equi joins or not at all."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.scalar import shared_uniform

AXES = ("x", "y", "z")
#: Places of a block that are put side by side before anything is gathered.
LANES = 8


def coordinate_grid(headers: DataFrame, shape: str = "shape", axes: Sequence[str] = AXES) -> DataFrame:
    """Every coordinate of every header's shape."""
    for k, a in enumerate(axes):
        headers = headers.withColumn(a, F.explode(F.sequence(F.lit(0), F.get(F.col(shape), F.lit(k)) - 1)))
    return headers


def axis_starts(image: int, patch: int, overlap: int) -> list[int]:
    """Starts of patches along an axis: steps of patch - overlap, the last one moved back to end with the image."""
    if patch > image or overlap >= patch:
        raise ValueError("the patch must fit, and exceed the overlap")
    starts = list(range(0, image - patch + 1, patch - overlap))
    return starts if starts[-1] == image - patch else [*starts, image - patch]


def patch_grid(image: Sequence[int], patch: Sequence[int], overlap: Sequence[int]) -> list[tuple[int, ...]]:
    """Starts of all patches in row-major order: a plan-time value of a few numbers per patch."""
    return list(product(*[axis_starts(*x) for x in zip(image, patch, overlap, strict=True)]))


def extract_patches(voxels: DataFrame, image: Sequence[int], patch: Sequence[int], overlap: Sequence[int], axes: Sequence[str]) -> DataFrame:
    """A row for each patch that a voxel lies in: ``patch_id``, start columns ``s{axis}``, and coordinates within the patch.

    Which starts hold a coordinate is looked up on the row itself, axis by axis; nothing is joined.
    """
    starts = [axis_starts(*x) for x in zip(image, patch, overlap, strict=True)]
    number = F.lit(0)
    for a, size, found in zip(axes, patch, starts, strict=True):
        places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(found)])
        voxels = voxels.withColumn(f"_{a}", F.explode(_holding(places, a, size)))
        number = number * len(found) + F.col(f"_{a}.k")
    voxels = voxels.withColumn("patch_id", number)
    for a in axes:
        voxels = voxels.withColumn(f"s{a}", F.col(f"_{a}.s")).withColumn(a, F.col(a) - F.col(f"_{a}.s"))
    return voxels.drop(*[f"_{a}" for a in axes])


def _holding(places: Column, axis: str, size: int) -> Column:
    return F.filter(places, lambda p: (p["s"] <= F.col(axis)) & (F.col(axis) < p["s"] + size))


def stitch(patches: DataFrame, values: Sequence[str], axes: Sequence[str], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Means of overlapping patches' values at their places in the image."""
    there = patches.withColumns({a: F.col(a) + F.col(f"s{a}") for a in axes})
    return there.groupBy(*keys, *axes).agg(*[F.avg(v).alias(v) for v in values])


def crop(voxels: DataFrame, lower: dict[str, Column | int], size: dict[str, Column | int]) -> DataFrame:
    """The box from ``lower``, with coordinates moved to start there."""
    for a, low in lower.items():
        voxels = voxels.where((F.col(a) >= low) & (F.col(a) < low + size[a])).withColumn(a, F.col(a) - low)
    return voxels


def random_patch_corner(uid: Column, image: int, patch: int, axis: str, seed: int) -> Column:
    """A corner on [0, image - patch), the end excluded; 0 if both are equal."""
    span = image - patch
    return F.lit(0) if span <= 0 else F.floor(shared_uniform(seed, f"corner-{axis}", uid) * span).cast("int")


def center_pad(current: Column | int, target: Column | int) -> tuple[Column, Column]:
    """Rows to add before and after: half of what is missing, rounded down, and the rest."""
    need = F.greatest(F.lit(target) - current if not isinstance(target, Column) else target - current, F.lit(0))
    return F.floor(need / 2).cast("int"), (need - F.floor(need / 2)).cast("int")


def center_crop(current: Column | int, target: Column | int) -> tuple[Column, Column]:
    need = F.greatest(current - (target if isinstance(target, Column) else F.lit(target)), F.lit(0))
    return F.floor(need / 2).cast("int"), (need - F.floor(need / 2)).cast("int")


def pad(voxels: DataFrame, headers: DataFrame, target: Sequence[int], axes: Sequence[str], values: dict[str, float | int], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Voxels in the middle of a grid of the target shape, padded with ``values``. headers: keys and ``shape``."""
    shift = {a: center_pad(F.get("shape", F.lit(k)), target[k])[0] for k, a in enumerate(axes)}
    moved = voxels.join(headers.select(*keys, "shape"), list(keys)).withColumns({a: F.col(a) + s for a, s in shift.items()}).drop("shape")
    full = F.array(*[F.greatest(F.get("shape", F.lit(k)), F.lit(t)) for k, t in enumerate(target)])
    grid = coordinate_grid(headers.select(*keys, full.alias("shape")), axes=axes).drop("shape")
    return grid.join(moved, [*keys, *axes], "left").fillna(values)


def label_crop(lo: Column, hi: Column, length: Column | int, target: int) -> tuple[Column, Column]:
    """Rows to cut below and above so that ``target`` rows stay around the middle of the label's box [lo, hi), inside the image.

    NULL where the box is not inside of the image, as an empty label's is not.
    """
    length = length if isinstance(length, Column) else F.lit(length)
    t = F.least(F.lit(target), length)
    low = F.ceil((hi - 1 + lo) / 2 - t / 2)
    low = F.least(F.greatest(low, F.lit(0)), length - t).cast("int")
    fits = (lo >= 0) & (hi > lo) & (hi <= length)
    return F.when(fits, low), F.when(fits, (length - t - low).cast("int"))


def flip(coordinate: Column, size: Column | int, flag: Column) -> Column:
    return F.when(flag, (size if isinstance(size, Column) else F.lit(size)) - 1 - coordinate).otherwise(coordinate)


def to_tiles(voxels: DataFrame, block: Sequence[int], axes: Sequence[str], keys: Sequence[str] = ("uid",), value: str = "value") -> DataFrame:
    """Rectangular blocks with their values in row-major order; missing voxels are NULL, one given twice is an error. A block bounds what is gathered.

    Values are put side by side by plain sums of ``LANES`` places first, so that only their rows are gathered into arrays.
    """
    origin = {f"o{a}": (F.floor(F.col(a) / b) * b).cast("int") for a, b in zip(axes, block, strict=True)}
    place = F.lit(0)
    n = 1
    for a, b in zip(axes, block, strict=True):
        place, n = place * b + F.pmod(F.col(a), F.lit(b)), n * b
    at, chunks = place.cast("int"), -(-n // LANES)
    rows = voxels.select(*keys, *[c.alias(o) for o, c in origin.items()], F.floor(at / LANES).cast("int").alias("_c"), (at % LANES).alias("_k"), F.col(value).cast("float").alias("_v"))
    lanes = rows.groupBy(*keys, *origin, "_c").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_{k}") for k in range(LANES)], F.bit_or(F.expr("shiftleft(1, _k)")).alias("_m"), F.count("*").alias("_n"))
    found = F.when(F.bit_count("_m") == F.col("_n"), F.array(*[f"_{k}" for k in range(LANES)])).otherwise(F.raise_error(F.lit("a voxel is given twice")).cast("array<float>"))
    cells = lanes.groupBy(*keys, *origin).agg(F.collect_list(F.struct("_c", found.alias("v"))).alias("_h"))
    empty = F.array(*[F.lit(None).cast("float")] * LANES)
    missing = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(chunks - 1)), F.col("_h._c")), lambda c: F.struct(c.alias("_c"), empty.alias("v")))
    whole = F.array_sort(F.when(F.size("_h") == chunks, F.col("_h")).otherwise(F.concat("_h", missing)))
    data = F.flatten(F.transform(whole, lambda c: c["v"]))
    return cells.select(*keys, *origin, *[F.lit(b).alias(f"s{a}") for a, b in zip(axes, block, strict=True)], (data if n % LANES == 0 else F.slice(data, 1, n)).alias("data"))


def from_tiles(tiles: DataFrame, axes: Sequence[str], keys: Sequence[str] = ("uid",), value: str = "value") -> DataFrame:
    rows = tiles.select(*keys, *[f"o{a}" for a in axes], *[f"s{a}" for a in axes], F.posexplode("data").alias("_at", value)).where(F.col(value).isNotNull())
    at, places = F.col("_at"), {}
    for a in reversed(axes):
        places[a] = (F.col(f"o{a}") + at % F.col(f"s{a}")).cast("int")
        at = F.floor(at / F.col(f"s{a}"))
    return rows.select(*keys, *[places[a].alias(a) for a in axes], value)

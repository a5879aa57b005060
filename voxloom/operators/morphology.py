"""Morphology and connected components of masks as runs.

A mask is a table of maximal runs, ``keys, <lines>, lo, hi``: all its voxels on a line along the last axis that follow each other.
A structuring element is a few chords. Dilation moves and widens runs by every chord, erosion narrows them, and a sweep over
a line's ends tells where enough of them overlap, so that work follows runs and chords, not voxels and offsets.
Components are found within tiles of lines first, without a shuffle of their links, and only what touches across tiles is
joined in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.groups import whole_groups
from voxloom.functions.tables import cut_lineage, joined

#: Lines along each side of a tile of components, and runs that are taken together.
TILE, ROWS = 64, 1 << 16


def box(size: int) -> list[tuple[int, int]]:
    """Offsets of a full square element."""
    r = size // 2
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def disk(radius: int, reach: float = 0.0) -> list[tuple[int, int]]:
    """Offsets within ``radius + reach`` of the middle."""
    return [(i, j) for i, j in box(2 * radius + 1) if i * i + j * j <= (radius + reach) ** 2]


def octagon(half: int, reach: int) -> list[tuple[int, int]]:
    """Offsets of a square of side 2 half + 1 whose corners are cut where both offsets add up to more than ``reach``."""
    return [(i, j) for i, j in box(2 * half + 1) if abs(i) + abs(j) <= reach]


#: The elements of the ultrasound clean-up for eroding, dilating and opening: fixed values, (half, reach) of octagons.
ULTRASOUND = (octagon(2, 4), octagon(4, 6), octagon(9, 14))


def chords(offsets: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """An element's offsets as runs: line, first and last place."""
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(set(offsets)):
        if out and out[-1][0] == i and out[-1][2] == j - 1:
            out[-1] = (i, out[-1][1], j)
        else:
            out.append((i, j, j))
    return out


def to_runs(rows: DataFrame, keys: Sequence[str] = ("uid",), axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """The runs of voxel rows; repeated rows count once."""
    *lines, last = axes
    w = Window.partitionBy(*keys, *lines).orderBy(last)
    starts = rows.select(*keys, *axes).withColumn("_s", F.coalesce(F.col(last) - F.lag(last).over(w), F.lit(2)) > 1).withColumn("_r", F.count_if("_s").over(w))
    return starts.groupBy(*keys, *lines, "_r").agg(F.min(last).alias("lo"), F.max(last).alias("hi")).drop("_r")


def from_runs(runs: DataFrame, last: str = "y") -> DataFrame:
    return runs.withColumn(last, F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def covered(spans: DataFrame, needed: Column, keys: Sequence[str], line: str = "x") -> DataFrame:
    """Maximal runs of places that at least ``needed`` (an expression of the line) of the spans ``keys, line, lo, hi`` cover."""
    ends = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
    w = Window.partitionBy(*keys, line).orderBy("at")
    depth = spans.where("lo <= hi").select(*keys, line, F.inline(ends)).withColumn("n", F.sum("d").over(w)).withColumn("next", F.lead("at").over(w))
    deep = depth.where("next IS NULL OR next > at").withColumn("in", F.col("n") >= needed)
    turns = deep.withColumn("was", F.coalesce(F.lag("in").over(w), F.lit(False))).where("in <> was")
    return turns.withColumn("end", F.lead("at").over(w)).where("in").select(*keys, line, F.col("at").alias("lo"), (F.col("end") - 1).cast("int").alias("hi"))


def dilated(runs: DataFrame, offsets: Sequence[tuple[int, int]], shape: Sequence[int], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Runs of the places that the element reaches from some voxel."""
    element = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("iab", c, strict=True)]) for c in chords(offsets)])
    moved = runs.select(*keys, "x", "lo", "hi", F.inline(element)).select(*keys, (F.col("x") + F.col("i")).alias("x"), F.greatest(F.col("lo") + F.col("a"), F.lit(0)).alias("lo"), F.least(F.col("hi") + F.col("b"), F.lit(shape[1] - 1)).alias("hi"))
    return covered(moved.where(F.col("x").between(0, shape[0] - 1)), F.lit(1), keys)


def eroded(runs: DataFrame, offsets: Sequence[tuple[int, int]], shape: Sequence[int], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Runs of the places from which the element reaches voxels only; its parts outside of the image take no part, and a place from which all of it is outside isn't kept."""
    cut = chords(offsets)
    element = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("iab", c, strict=True)]) for c in cut])
    # a run that meets the image's border holds beyond it, but for places whose whole chord is beyond: those are added below
    lo = F.when(F.col("lo") <= 0, F.greatest(F.lit(0), -F.col("b"))).otherwise(F.greatest(F.col("lo") - F.col("a"), F.lit(0)))
    hi = F.when(F.col("hi") >= shape[1] - 1, F.least(F.lit(shape[1] - 1), shape[1] - 1 - F.col("a"))).otherwise(F.least(F.col("hi") - F.col("b"), F.lit(shape[1] - 1)))
    moved = runs.select(*keys, "x", "lo", "hi", F.inline(element)).select(*keys, (F.col("x") - F.col("i")).alias("x"), lo.alias("lo"), hi.alias("hi"))
    inside = lambda i: (F.col("x") + i).between(0, shape[0] - 1)
    moved = moved.where(F.col("x").between(0, shape[0] - 1))
    beyond = [c for c in cut if c[1] > 0 or c[2] < 0]
    if beyond:
        spans = F.filter(F.array(*[F.struct(inside(i).alias("in"), F.lit(max(0, shape[1] - a) if a > 0 else 0).alias("lo"), F.lit(shape[1] - 1 if a > 0 else min(shape[1], -b) - 1).alias("hi")) for i, a, b in beyond]), lambda s: s["in"])
        moved = moved.unionByName(moved.select(*keys, "x").distinct().select(*keys, "x", F.inline(spans)).drop("in"))
    found = covered(moved, sum(inside(i).cast("int") for i, _, _ in cut), keys)
    if beyond:  # no part of the element is in the image
        reached = [(i, max(0, -b), min(shape[1] - 1, shape[1] - 1 - a)) for i, a, b in cut]
        least, most = (f(F.filter(F.array(*[F.when(inside(r[0]), F.lit(r[k])) for r in reached]), lambda v: v.isNotNull())) for k, f in ((1, F.array_min), (2, F.array_max)))
        found = found.withColumns({"lo": F.greatest("lo", least), "hi": F.least("hi", most)}).where("lo <= hi")
    return found


def opened(runs: DataFrame, offsets: Sequence[tuple[int, int]], shape: Sequence[int], keys: Sequence[str] = ("uid",)) -> DataFrame:
    return dilated(eroded(runs, offsets, shape, keys), offsets, shape, keys)


def _of_rows(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(rows: DataFrame, offsets: Sequence[tuple[int, int]], shape: Sequence[int], keys: Sequence[str] = ("uid",)) -> DataFrame:
        return from_runs(f(to_runs(rows, keys), offsets, shape, keys))

    run.__doc__ = f"{f.__name__} of voxel rows ``keys, x, y``."
    return run


dilate, erode, opening = _of_rows(dilated), _of_rows(eroded), _of_rows(opened)


def _touching(line: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a run and a run on the line ``other`` of it (-1: none) that touch; runs are sorted by line and place."""
    wide = int(hi.max(initial=0)) + 2 * reach + 2
    low = int(lo.min(initial=0)) - reach
    wide -= low
    first = np.searchsorted(line * wide + hi - low, other * wide + lo - reach - low)
    stop = np.searchsorted(line * wide + lo - low, other * wide + hi + reach - low, side="right")
    n = np.where(other >= 0, np.maximum(stop - first, 0), 0)
    a = np.repeat(np.arange(len(lo)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + first[a]


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is linked with over links a, b: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        u, v = root[a], root[b]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _steps(dims: int, diagonal: bool) -> list[tuple[int, ...]]:
    """Steps to the lines before which a line's neighbours are looked for, one of each opposite two."""
    return [s for s in product((-1, 0, 1), repeat=dims) if s > (0,) * dims and (diagonal or sum(map(abs, s)) == 1)]


def _local(keys: list[str], lines: list[str], tiles: list[str], diagonal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for table, group in whole_groups(batches, [*keys, *tiles], ROWS):
            lo, hi = table.column("lo").to_numpy().astype(int), table.column("hi").to_numpy().astype(int)
            # lines numbered so that neighbours are found by number: tiles apart, a margin around each
            code = group.astype(int)
            for a in lines:
                code = code * (TILE + 2) + table.column(a).to_numpy() % TILE + 1
            pairs = [_touching(code, lo, hi, code + int(np.dot(s, [(TILE + 2) ** (len(lines) - 1 - k) for k in range(len(lines))])), int(diagonal)) for s in _steps(len(lines), diagonal)]
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            yield from table.append_column("component", pa.array(base + _least(len(lo), a, b), pa.int64())).combine_chunks().to_batches()
            base += len(lo)

    return run


def run_components(runs: DataFrame, keys: Sequence[str] = ("uid",), lines: Sequence[str] = ("x",), diagonal: bool = True, max_rounds: int = 100) -> DataFrame:
    """``runs`` with ``component``: a number of the connected set of runs, the same within its keys.

    Tiles of lines are dealt out whole and settled in one pass. Runs on lines at a tile's rim are joined with those across it, and
    the least number spreads over these links, and by pointer jumping, until nothing changes; every round is written.
    """
    keys, lines = list(keys), list(lines)
    tiles = [f"_t_{a}" for a in lines]
    split = runs.select(*keys, *lines, "lo", "hi", *[F.floor(F.col(a) / TILE).alias(t) for a, t in zip(lines, tiles, strict=True)])
    split = split.repartition(*keys, *tiles).sortWithinPartitions(*keys, *tiles, *lines, "lo")
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema] + ["component long"])
    local = cut_lineage(split.mapInArrow(_local(keys, lines, tiles, diagonal), kinds))
    reach = int(diagonal)
    other = local.select(*keys, *[F.col(a).alias(f"_o_{a}") for a in lines], F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("component").alias("b"))
    near = None
    for s in _steps(len(lines), diagonal):
        beside = {f"_o_{a}": F.col(a) + v for a, v in zip(lines, s, strict=True)}
        rim = local.withColumns(beside).where(" OR ".join(f"floor(_o_{a} / {TILE}) <> {t}" for a, t in zip(lines, tiles, strict=True)))
        near = rim if near is None else near.unionByName(rim)
    links = joined(near, other, [*keys, *[f"_o_{a}" for a in lines]]).where((F.col("lo") <= F.col("o_hi") + reach) & (F.col("o_lo") <= F.col("hi") + reach))
    links = cut_lineage(links.select(F.col("component").alias("a"), "b").distinct())
    if links.isEmpty():
        return local.drop(*tiles)
    links = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = links.select(F.col("a").alias("run")).distinct().select("run", F.col("run").alias("least"))
    for _ in range(max_rounds):
        seen = joined(links, label.withColumnRenamed("run", "b"), ["b"]).groupBy(F.col("a").alias("run")).agg(F.min("least").alias("m"))
        least = joined(label, seen, ["run"], "left").select("run", "least", F.least("least", F.coalesce("m", "least")).alias("m"))
        jump = least.select(F.col("run").alias("m"), F.col("m").alias("m2"))  # pointer jumping: the label of the run that names the label
        to = F.least("m", F.coalesce("m2", "m"))
        new = cut_lineage(joined(least, jump, ["m"], "left").select("run", to.alias("new"), (to != F.col("least")).alias("changed")))
        label = new.select("run", F.col("new").alias("least"))
        if new.where("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = joined(local, label.withColumnRenamed("run", "component"), ["component"], "left")
    return named.select(*keys, *lines, "lo", "hi", F.coalesce("least", "component").alias("component"))


def components(rows: DataFrame, keys: Sequence[str] = ("uid",), axes: Sequence[str] = ("x", "y"), diagonal: bool = True, max_rounds: int = 100) -> DataFrame:
    """Voxel rows ``keys, axes`` with ``component``; with ``diagonal`` voxels that share a corner touch."""
    found = run_components(to_runs(rows, keys, axes), keys, axes[:-1], diagonal, max_rounds)
    return from_runs(found, axes[-1]).select(*keys, *axes, "component")


def filled(runs: DataFrame, shape: Sequence[int], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Runs of the foreground and of every background voxel from which no path of 4-neighbours leads to the image's border.

    Holes lie within the foreground's box, so background is only made there and one voxel around; it is open where it
    reaches that margin or the image's border.
    """
    keys = list(keys)
    runs = cut_lineage(runs.select(*keys, "x", "lo", "hi"))
    ends = {"x0": F.greatest(F.min("x") - 1, F.lit(0)), "x1": F.least(F.max("x") + 1, F.lit(shape[0] - 1)), "y0": F.greatest(F.min("lo") - 1, F.lit(0)), "y1": F.least(F.max("hi") + 1, F.lit(shape[1] - 1))}
    frame = runs.groupBy(*keys).agg(*[v.alias(n) for n, v in ends.items()])
    held = runs.groupBy(*keys, "x").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))  # at most half as many as a line is long
    rows = frame.withColumn("x", F.explode(F.sequence("x0", "x1"))).transform(joined, held, [*keys, "x"], "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<lo:int,hi:int>>")))
    starts = F.concat(F.array("y0"), F.transform("r", lambda r: r["hi"] + 1))
    stops = F.concat(F.transform("r", lambda r: r["lo"] - 1), F.array("y1"))
    gaps = rows.select(*keys, "x", "x0", "x1", "y0", "y1", F.inline(F.arrays_zip(starts.alias("lo"), stops.alias("hi")))).where("lo <= hi")
    gaps = cut_lineage(gaps.select(*keys, "x", "lo", "hi", F.expr("x = x0 OR x = x1 OR lo = y0 OR hi = y1").alias("open")))
    back = joined(run_components(gaps.drop("open"), keys, diagonal=False), gaps, [*keys, "x", "lo", "hi"])
    holes = joined(back, back.where("open").select(*keys, "component").distinct(), [*keys, "component"], "left_anti")
    return covered(runs.unionByName(holes.select(*keys, "x", "lo", "hi")), F.lit(1), keys)


def fill_holes(rows: DataFrame, shape: Sequence[int], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Voxel rows with their holes filled; see :func:`filled`."""
    return from_runs(filled(to_runs(rows, keys), shape, keys))


def ranked_components(runs: DataFrame, axis: str = "y", keys: Sequence[str] = ("uid",), top: int = 2) -> DataFrame:
    """``keys, place, component, n, left``: the largest components by number of voxels, with their least ``axis`` coordinate; ties go to the smaller coordinates."""
    left = F.min("lo" if axis == "y" else axis)
    sizes = runs.groupBy(*keys, "component").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"), left.alias("left"), F.min(F.struct("x", "lo")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return sizes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(*keys, "place", "component", "n", "left")


def selected(runs: DataFrame, threshold: float = 0.75, axis: str = "y", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Runs of one 8-connected component: the largest, unless the second exceeds ``threshold`` of it; then the largest only if its least
    ``axis`` coordinate is strictly smaller, else the second.
    """
    labelled = cut_lineage(run_components(runs, keys))
    two = ranked_components(labelled, axis, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "component", "n", "left"))).alias("c"))
    a, b = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    keep = F.when(F.size("c") == 1, a["component"]).when(b["n"] <= threshold * a["n"], a["component"]).when(a["left"] < b["left"], a["component"]).otherwise(b["component"])
    return joined(labelled, two.select(*keys, keep.alias("component")), [*keys, "component"], "left_semi").select(*keys, "x", "lo", "hi")


def select_component(rows: DataFrame, threshold: float = 0.75, axis: str = "y", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Voxel rows of one component; see :func:`selected`."""
    return from_runs(selected(to_runs(rows, keys), threshold, axis, keys))


def clean_mask(rows: DataFrame, shape: Sequence[int], erode_by, dilate_by, open_by, threshold: float = 0.75, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Fill, erode, dilate, open, keep one component, and fill again; runs throughout. With a step among the keys every step is cleaned."""
    runs = dilated(eroded(filled(to_runs(rows, keys), shape, keys), erode_by, shape, keys), dilate_by, shape, keys)
    return from_runs(filled(selected(opened(runs, open_by, shape, keys), threshold, keys=keys), shape, keys))


def clean_predictions(voxels: DataFrame, shape: Sequence[int], elements=ULTRASOUND, threshold: float = 0.75, keys: Sequence[str] = ("uid",), pred: str = "label_pred") -> DataFrame:
    """Voxel rows with the foreground of ``pred`` cleaned to 0 and 1, others unchanged: a ``post`` hook of an evaluation."""
    kept = clean_mask(voxels.where(F.col(pred) > 0).select(*keys, "x", "y"), shape, *elements, threshold, keys).withColumn("_kept", F.lit(1))
    return joined(voxels, kept, [*keys, "x", "y"], "left").withColumn(pred, F.coalesce("_kept", F.lit(0))).drop("_kept")

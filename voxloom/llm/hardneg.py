"""Hard negatives: for an anchor and each of its nearest rows of its own label, the nearest rows of other labels in a score window.

Vectors become integers and scores are exact inner products, made by Strassen's recursion over tiles of anchors and candidates.
Anchors are a stated query set: they are broadcast in groups of a bounded size, and each group meets every candidate once for
positives and once for negatives, tile by tile. A task keeps fixed-size heaps (five rows an anchor, or an anchor and positive) and
emits them at its end; heaps of tasks are merged by a ranking within the anchor, which never sees more than five rows a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.llm.common import materialize, read

#: Candidates of one tile, anchors of one tile, and the products below which the recursion ends.
CANDIDATES, ANCHORS, LEAF = 2048, 512, 1 << 18
#: Components of the anchors that are broadcast at once (8 bytes each).
GROUP = 1 << 22
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven products of quarters; odd sides are padded with zeros. Exact: integers wrap on the way, not in the result."""
    (m, k), n = a.shape, b.shape[1]
    if m * k * n <= leaf or min(m, k, n) < 2:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((a.shape[0], b.shape[1]), p1.dtype)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and rows of b; the shorter vectors count as padded with zeros.

    Where a score may not fit 64 bits the same recursion runs on Python's integers, and scores stop at the ends of 64 bits.
    """
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
    most = [max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * max(d, 1) < 1 << 62:
        return strassen(a, np.ascontiguousarray(b.T))
    return np.clip(strassen(a.astype(object), b.T.astype(object)), _NONE + 1, _LAST - 1).astype(np.int64)


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k highest scores of each row, of equal ones those to the left, and their scores; absent ones are _NONE."""
    if s.shape[1] <= k:
        cols = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        return cols, s
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, ties = s > least, s == least
    take = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True)))
    cols = np.nonzero(take)[1].reshape(len(s), k)
    return cols, np.take_along_axis(s, cols, 1)


class Heaps:
    """The k best of every row so far: higher scores first, then smaller identifiers; two can be merged."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((rows, k), _NONE), np.full((rows, k), _LAST)

    def offer(self, rows: slice, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores of consecutive rows with columns by ascending identifier."""
        top = s.max(1, initial=_NONE)
        hot = np.nonzero((top >= self.score[rows, -1]) & (top > _NONE))[0]
        if len(hot):
            cols, found = best(s[hot], self.k)
            self.merge(np.arange(rows.start, rows.stop)[hot], found, ids[cols])

    def merge(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        s, ids = np.hstack([self.score[rows], s]), np.hstack([self.id[rows], ids])
        order = np.lexsort((ids, -s, s == _NONE), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Label, identifiers and vectors of up to ``size`` consecutive rows of one label."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        labels, ids = (table.column(c).to_numpy() for c in ("label", "id"))
        vectors = table.column("v").combine_chunks()
        flat, at = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
        ends = [0, *(np.nonzero(np.diff(labels))[0] + 1), len(labels)]
        for first, last in zip(ends, ends[1:]):
            for i in range(first, last, size):
                j = min(last, i + size)
                yield int(labels[i]), ids[i:j], _matrix(flat[at[i] : at[j]], np.diff(at[i : j + 1]))

    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= size:
            yield from cut(held)
            held, rows = [], 0
    if rows:
        yield from cut(held)


def _matrix(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of the given lengths, padded with zeros on the right."""
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return flat.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out


def _emit(heaps: Heaps, names: list[str], columns: list[np.ndarray], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """A record for every filled place of the heaps: the heap's own columns, identifier and score."""
    r, c = np.nonzero(heaps.score > _NONE)
    for i in range(0, len(r), size):
        at = r[i : i + size]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[at], pa.int64()) for x in columns), pa.array(heaps.id[at, c[i : i + size]], pa.int64()), pa.array(heaps.score[at, c[i : i + size]], pa.int64())], names=[*names, "id", "score"])


def _positives(sent, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, bounds = sent.value
        heaps = Heaps(len(ids), k)
        for label, own, tile in _tiles(batches, CANDIDATES):
            first, last = bounds.get(label, (0, 0))
            for i in range(first, last, ANCHORS):
                rows = slice(i, min(last, i + ANCHORS))
                s = scores(vectors[rows], tile)
                s[ids[rows, None] == own[None, :]] = _NONE
                heaps.offer(rows, s, own)
        yield from _emit(heaps, ["row"], [np.arange(len(ids))])

    return run


def _negatives(sent, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, bounds, least, most = sent.value
        heaps = Heaps(least.size, k)
        for label, own, tile in _tiles(batches, CANDIDATES):
            first, last = bounds.get(label, (0, 0))
            for start, stop in ((0, first), (last, len(ids))):
                for i in range(start, stop, ANCHORS):
                    rows = slice(i, min(stop, i + ANCHORS))
                    s = scores(vectors[rows], tile)
                    for p in range(len(least)):
                        inside = (s >= least[p][rows, None]) & (s <= most[p][rows, None])
                        if inside.any():
                            base = p * len(ids)
                            heaps.offer(slice(base + rows.start, base + rows.stop), np.where(inside, s, _NONE), own)
        rows = np.arange(least.size)
        yield from _emit(heaps, ["row", "place"], [rows % len(ids), rows // len(ids) + 1])

    return run


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key: the heaps of tasks merged."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """``id, label, v``: rows that take part, components as floor(scale * x) in 64 bits."""
    x = F.transform(vectors[vector_col].cast("array<double>"), lambda c: F.floor(F.lit(scale) * c))
    rows = vectors.select(F.coalesce(vectors[id_col].cast("long"), F.lit(_LAST)).alias("id"), label.cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("raw"), x.alias("v"))
    whole = ~F.exists("raw", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return rows.where(F.col("label").isNotNull() & F.col("raw").isNotNull() & whole).select("id", "label", "v")


def _mined(rows: DataFrame, asked: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one group of anchors of a bounded size."""
    spark = rows.sparkSession
    anchors = sorted((r.label, r.id, r.v) for r in asked.collect())
    if not anchors:
        return spark.createDataFrame([], _MINED)
    labels, ids = (np.array([r[k] for r in anchors], np.int64) for k in (0, 1))
    vectors = _matrix(np.array([x for r in anchors for x in r[2]], np.int64), np.array([len(r[2]) for r in anchors]))
    firsts = np.concatenate([[0], np.nonzero(np.diff(labels))[0] + 1])
    bounds = {int(labels[f]): (int(f), int(e)) for f, e in zip(firsts, [*firsts[1:], len(labels)], strict=True)}
    sent = spark.sparkContext.broadcast((ids, vectors, bounds))
    near = _ranked(rows.mapInArrow(_positives(sent, positives), "row long, id long, score long"), ["row"], positives)
    near = materialize(near.withColumnsRenamed({"id": "positive_id", "score": "positive_score", "rank": "place"}), "positives")
    least, most = np.full((positives, len(ids)), _LAST), np.full((positives, len(ids)), _NONE)
    for r in near.collect():  # at most so many positives an anchor of the group
        least[r.place - 1, r.row], most[r.place - 1, r.row] = max(_NONE + 1, -(-low * r.positive_score // 100)), min(_LAST, high * r.positive_score // 100)
    windows = spark.sparkContext.broadcast((ids, vectors, bounds, least, most))
    far = _ranked(rows.mapInArrow(_negatives(windows, negatives), "row long, place long, id long, score long"), ["row", "place"], negatives)
    far = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    names = F.broadcast(spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "row long, anchor_id long"))
    return far.join(F.broadcast(near), ["row", "place"]).join(names, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    is_anchor: a condition on the identifier (column ``id``). label: the label column or an expression of it. Positives are the
    anchor's first rows of its label, negatives the first rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score``; higher scores first, then smaller identifiers.
    Rows with a null label, a null vector or a null or non-finite component take no part. Rows with a null identifier do, last
    among ties, and are never anchors. Rows with the anchor's own identifier are the anchor itself; other repeated rows count each. Vectors
    of different lengths are padded with zeros. Anchors repeated with one identifier and label are one anchor, that with the
    smallest vector. Other columns are ignored; an empty table gives no rows.
    """
    rows = integer_rows(vectors, id_col, vector_col, F.col("label") if label is None else label, scale)
    # Tiles are runs of one label by ascending identifier; tasks get their share of every label.
    rows = materialize(rows.repartition(F.col("id"), F.xxhash64("v")).sortWithinPartitions("label", "id"), "vectors")
    asked = rows.where(is_anchor & (F.col("id") < _LAST)).groupBy("id", "label").agg(F.min("v").alias("v"))
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int")), "anchors")
    size = asked.agg(F.coalesce(F.sum(F.size("v") + 4), F.lit(0))).first()[0]
    groups = max(1, -(-size // group))
    sizes = lambda: asked.groupBy(F.pmod("part", F.lit(groups))).agg(F.sum(F.size("v") + 4).alias("n")).agg(F.max("n")).first()[0]
    while 1 < groups < 1 << 20 and sizes() > 2 * group:
        groups *= 2
    out = _mined(rows, asked.where(F.pmod("part", F.lit(groups)) == 0), positives, negatives, low, high)
    for g in range(1, groups):
        out = out.unionByName(materialize(_mined(rows, asked.where(F.pmod("part", F.lit(groups)) == g), positives, negatives, low, high), "mined"))
    real = lambda c: F.when(F.col(c) < _LAST, F.col(c)).alias(c)
    return out.select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


SQL = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
}

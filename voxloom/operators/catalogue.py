"""Catalogues of scans: pairing, splits, batches, checkpoints' metrics and geometry checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from voxloom.functions.tables import numbered


def path_to_uid(path: Column, prefix: str = "amos_", suffix: str = ".nii.gz") -> Column:
    """File name without prefix and suffix, wherever in it they are."""
    return F.replace(F.replace(F.element_at(F.split(path, "/"), -1), F.lit(prefix), F.lit("")), F.lit(suffix), F.lit(""))


def keep_modality(paths: DataFrame, path: str = "path", most: int = 500) -> DataFrame:
    """Rows whose numeric identifier is at most ``most``."""
    return paths.where(path_to_uid(F.col(path)).cast("int") <= most)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs become columns named by their path."""

    def leaves(kind: StructType, path: tuple[str, ...]):
        for f in kind.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())])


def pair_images(images: DataFrame, masks: DataFrame, on: str = "uid") -> DataFrame:
    """Images that also have a mask."""
    return images.join(masks, on, "left_semi")


def complete_uids(files: DataFrame, needed: int, uid: Sequence[str] = ("uid",), modality: str = "modality") -> DataFrame:
    """Identifiers that have all ``needed`` modalities, in one shuffle."""
    return files.groupBy(*uid).agg(F.count_distinct(modality).alias("n")).where(F.col("n") == needed).drop("n")


def intersect_uids(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def geometry_violations(a: DataFrame, b: DataFrame, fields: Sequence[str] = ("spacing", "origin", "direction"), rtol: float = 1e-5, atol: float = 1e-3) -> DataFrame:
    """``uid, field`` of headers that differ: sizes at all, other fields by more than atol + rtol * |b|."""
    other = b.select("uid", *[F.col(f).alias(f"b_{f}") for f in ("shape", *fields) if f in b.columns])
    both = a.join(other, "uid")

    def far(f: str) -> Column:
        return (F.size(f) != F.size(f"b_{f}")) | F.exists(F.zip_with(f, f"b_{f}", lambda x, y: F.abs(x - y) > atol + rtol * F.abs(y)), lambda v: F.coalesce(v, F.lit(True)))

    tests = [F.when(far(f), F.lit(f)) for f in fields if f in a.columns]
    if "shape" in a.columns:
        tests.append(F.when(F.col("shape") != F.col("b_shape"), F.lit("shape")))
    return both.select("uid", F.explode(F.array_compact(F.array(*tests))).alias("field"))


def split_by_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows by membership of a split: in each group the first two are ``valid``, then up to int(0.75 n) - 2 ``train``, the rest ``test``.

    Positions are counted from the group's start in all three, so small groups overlap: a row may be in two splits, and
    a negative end counts from the group's end, as with slices.
    """
    w = Window.partitionBy(group)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    end = F.floor(F.col("_n") * 0.75).cast("int") - 2
    end = F.when(end < 0, F.greatest(end + F.col("_n"), F.lit(0))).otherwise(end)
    i = F.col("_i")
    sets = F.array(F.when(i < 2, F.lit("valid")), F.when((i >= 2) & (i < end), F.lit("train")), F.when(i >= end, F.lit("test")))
    return placed.withColumn("split", F.explode(F.array_compact(sets))).drop("_i", "_n")


def split_by_ratio(rows: DataFrame, order: str, ratio: float = 0.1) -> DataFrame:
    """The first int(ratio * n) rows stay ``valid``, the others become ``test``."""
    return numbered(rows, order).withColumn("split", F.when(F.col("_i") < F.floor(F.col("_n") * ratio), "valid").otherwise("test")).drop("_i", "_n")


def split_by_count(rows: DataFrame, order: str, train: int, test: int) -> DataFrame:
    """Of sorted rows the first ``train``, the last ``test``, and what is between as ``valid``."""
    split = F.when(F.col("_i") < train, "train").when(F.col("_i") >= F.col("_n") - test, "test").otherwise("valid")
    return numbered(rows, order).withColumn("split", split).drop("_i", "_n")


def shuffled(rows: DataFrame, uid: str, seed: int) -> DataFrame:
    """A global shuffle that depends on the seed and the identifiers alone."""
    return rows.orderBy(F.xxhash64(F.col(uid), F.lit(seed)), uid)


def batches(rows: DataFrame, order: str, size: int, drop_remainder: bool) -> DataFrame:
    """Rows with ``batch_id`` and ``slot``; an incomplete last batch goes if ``drop_remainder``."""
    placed = numbered(rows, order).withColumn("batch_id", F.floor(F.col("_i") / size)).withColumn("slot", F.col("_i") % size)
    if drop_remainder:
        placed = placed.where(F.col("batch_id") < F.floor(F.col("_n") / size))
    return placed.drop("_i", "_n")


def pad_batches(rows: DataFrame, batch: str, slot: str, size: int, values: Sequence[str], training: bool = False) -> DataFrame:
    """Every batch with slots 0 to size - 1; missing ones hold zeros and are marked. Training batches must be full."""
    slots = rows.select(batch).distinct().withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    out = slots.join(rows.withColumn("_real", F.lit(True)), [batch, slot], "left").withColumn("padded", F.col("_real").isNull()).drop("_real")
    if training:
        out = out.withColumn("padded", F.when(F.col("padded"), F.raise_error(F.lit("a training batch is not full"))).otherwise(F.lit(False)))
    return out.fillna(0, list(values))


def unpad(rows: DataFrame, batch: str, slot: str, uid: str) -> DataFrame:
    """Rows before their batch's first blank identifier."""
    first = F.min(F.when(F.col(uid) == "", F.col(slot))).over(Window.partitionBy(batch))
    return rows.withColumn("_f", first).where(F.col("_f").isNull() | (F.col(slot) < F.col("_f"))).drop("_f")


def even_shards(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Shards of consecutive rows whose sizes differ by one at most, the larger ones first."""
    i, size, larger = F.col("_i"), F.floor(F.col("_n") / shards), F.col("_n") % shards
    split = larger * (size + 1)
    shard = F.when(i < split, F.floor(i / (size + 1))).otherwise(larger + F.floor((i - split) / F.greatest(size, F.lit(1))))
    return numbered(rows, order).withColumn("shard", shard.cast("int")).drop("_i", "_n")


def best_checkpoint(metrics: DataFrame, largest: bool = True, keys: Sequence[str] = ("run",)) -> DataFrame:
    """The step with the best value; the smallest step wins ties; NULL and NaN values are left out."""
    rows = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    best = F.max_by if largest else F.min_by
    return rows.groupBy(*keys).agg(best("step", F.struct("value", -F.col("step") if largest else F.col("step"))).alias("step"), (F.max if largest else F.min)("value").alias("value"))


def newest(metrics: DataFrame, keep: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    return metrics.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("step")))).where(F.col("_k") <= keep).drop("_k")


def early_stop(metrics: DataFrame, patience: int, min_delta: float, largest: bool = True, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Where training of each run stops: the best value so far must be beaten by more than ``min_delta``, or ``patience`` checks end it.

    A run's history is one value per validation, a short list by nature; it is folded in step order.
    """
    v = F.lit(1.0) if largest else F.lit(-1.0)
    history = F.array_sort(F.collect_list(F.struct("step", (F.col("value") * v).alias("value"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop"))

    def fold(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (x["value"] - s["best"] > min_delta)
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        done = s["stop"].isNotNull()
        return F.struct(
            F.when(done, s["best"]).when(better, x["value"]).otherwise(s["best"]).alias("best"), F.when(done, s["wait"]).otherwise(wait).alias("wait"),
            F.when(done, s["stop"]).when(wait >= patience, x["step"].cast("long")).alias("stop"),
        )

    folded = metrics.groupBy(*keys).agg(history.alias("h")).select(*keys, F.aggregate("h", start, fold).alias("s"))
    return folded.select(*keys, F.col("s.stop").alias("stop_step"), (F.col("s.best") * v).alias("best"))


def wide(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ("uid",)) -> DataFrame:
    """One row per key and one column per metric."""
    return metrics.groupBy(*keys).pivot("metric", list(names)).agg(F.first("value"))


def merge_families(families: Sequence[DataFrame], keys: Sequence[str] = ("uid", "cls", "metric")) -> DataFrame:
    """Metric families in one table; a later family wins where names repeat."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("_k", F.lit(k)) for k, f in enumerate(families)])
    return rows.groupBy(*keys).agg(F.max_by("value", "_k").alias("value"))

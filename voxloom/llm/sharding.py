"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Only column functions, joins and grouped sums are used. A split's place is found in nested histograms: sums of
bytes by node and coordinate bucket, and again within the bucket on the border, until the border is a single
coordinate. Coordinates end in bits of a hash of the row, so that a value that a third of all rows share still has a
median. Every level handles all nodes at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.llm.common import join_bounded, materialize, read

#: Bits of a coordinate's value and of the tie-breaking hash below it, and of one histogram.
VALUE_BITS, TIE_BITS, STEP_BITS = 20, 28, 12


def _text_coordinate(col: Column) -> Column:
    """A label's place: its hash, spread over [0, 1); null has a place of its own."""
    return F.pmod(F.xxhash64(F.coalesce(col.cast("string"), F.lit("\0"))), F.lit(1 << 20)) / float(1 << 20)


def kd_shards(rows: DataFrame, size: Column, dims: dict[str, Column], id_col: str, shards: int) -> DataFrame:
    """``rows`` as ``(row, size, shard)``: ``shards`` leaves of near-equal summed ``size``. Rows should be narrow: they travel along.

    dims: numeric columns (any scale) and string columns. A node that must become k shards is split so that its sides
    hold floor(k/2) and the rest of its bytes. Null coordinates count as 0, or as a label of their own.
    """
    kinds = dict(rows.select(*[c.alias(n) for n, c in dims.items()]).dtypes)
    coords = {n: _text_coordinate(c) if kinds[n] == "string" else F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in dims.items()}
    tie = F.pmod(F.xxhash64(rows[id_col].cast("string"), size), F.lit(1 << TIE_BITS))
    base = materialize(rows.select(F.struct(*rows.columns).alias("row"), size.cast("long").alias("size"), tie.alias("tie"), *[c.alias(f"d_{n}") for n, c in coords.items()]), "kd")
    names = [f"d_{n}" for n in dims]
    spans = base.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()

    def place(n: str) -> Column:
        lo, hi = spans[f"lo_{n}"], spans[f"hi_{n}"]
        scaled = F.lit(0) if lo is None or hi <= lo else F.least(F.floor((F.col(n) - lo) / (hi - lo) * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1))
        return scaled.cast("long") * (1 << TIE_BITS) + F.col("tie")

    level = base.select("row", "size", *[place(n).alias(n) for n in names], F.lit(0).alias("shard"), F.lit(shards).alias("k"))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        level = materialize(_split(level, names), "kd-level")
    return level.select("row", "size", "shard")


def _split(slim: DataFrame, names: Sequence[str]) -> DataFrame:
    """One level: every node of two or more shards gives its upper side to new shards; ``shard`` is the lowest of a node."""
    todo = slim.where("k > 1")
    widths = [F.shiftright(F.max(n), TIE_BITS) - F.shiftright(F.min(n), TIE_BITS) for n in names]
    nodes = todo.groupBy("shard", "k").agg(F.sum("size").alias("total"), F.array(*widths).alias("widths"))
    nodes = nodes.withColumn("axis", F.array_position("widths", F.array_max("widths")).cast("int") - 1).withColumn("below_k", F.floor(F.col("k") / 2).cast("int"))
    nodes = materialize(nodes.select(F.col("shard").alias("node"), "axis", "below_k", (F.col("total") * F.col("below_k") / F.col("k")).alias("goal")), "kd-nodes")

    def value(axis: Column) -> Column:
        return F.element_at(F.array(*names), axis + 1)

    bits = VALUE_BITS + TIE_BITS
    search = nodes.select("node", "axis", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    order, ended = Window.partitionBy("node").orderBy("bucket"), []
    for used in range(STEP_BITS, bits + 1, STEP_BITS):
        width = bits - used
        near = join_bounded(todo.select(F.col("shard").alias("node"), "size", *names), search, ["node"], "inner").withColumn("v", value(F.col("axis")))
        near = near.where(F.shiftright("v", width + STEP_BITS) == F.col("prefix"))
        sums = near.groupBy("node", "axis", "goal", "below", F.shiftright("v", width).alias("bucket")).agg(F.sum("size").alias("in_bucket"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = sums.withColumn("upto", F.col("below") + F.sum("in_bucket").over(order))
        found = upto.where("upto >= goal").groupBy("node").agg(F.min(F.struct("bucket", "axis", "goal", (F.col("upto") - F.col("in_bucket")).alias("below"), "in_bucket", "low", "high")).alias("x"))
        found = materialize(found.select("node", "x.*"), "kd-border")
        ended.append(found.where("low = high"))
        search = found.where("low < high").select("node", "axis", "goal", F.col("bucket").alias("prefix"), "below")
        if not search.limit(1).count():
            break
    # The border row goes to the side that then comes nearer to the goal.
    nearer = (F.col("below") + F.col("in_bucket") - F.col("goal")) < (F.col("goal") - F.col("below"))
    cuts = reduce(DataFrame.unionByName, ended).select("node", F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("cut"))
    cuts = materialize(nodes.join(cuts, "node").select("node", "axis", "below_k", "cut"), "kd-cuts")
    out = join_bounded(slim, cuts, F.col("shard") == F.col("node"), "left")
    up = value(F.col("axis")) > F.col("cut")
    k = F.when(F.col("node").isNull(), F.col("k")).when(up, F.col("k") - F.col("below_k")).otherwise(F.col("below_k"))
    shard = F.when(F.col("node").isNull() | ~up, F.col("shard")).otherwise(F.col("shard") + F.col("below_k"))
    return out.select("row", "size", *names, shard.alias("shard"), k.alias("k"))


def gapless(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with ``slot`` added: 0, 1, ... in each ``group`` by ``order``. Groups of any size spread over tasks.

    Rows are range-partitioned by both columns; a row's slot is its place in its task plus what earlier tasks hold of its group.
    """
    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("task", F.shiftright("at", 33)), "ranged")
    parts = ranged.groupBy(group, "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select(group, "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "parts")
    return join_bounded(ranged, parts, [group, "task"], "inner").withColumn("slot", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", labels: Sequence[str] = ("lang", "source"), target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    There are as many leaves as ``target_bytes`` needs, where it is given, so that a leaf has about as many bytes or fewer; else
    ``shards``. Equal texts aren't kept together: the law balances bytes, and a group of copies may exceed a shard.

    size: UTF-8 bytes of the text (null: none) plus 16. Dimensions: size, identifier and the ``labels``. The law is
    ``bytes``: shards differ by about the rows on their borders. grown_shard is null under this law. Null texts count as
    empty; rows with equal identifiers and sizes stay together; null identifiers and labels have their own place;
    other columns are ignored; an empty table gives no rows.
    """
    data = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    size = F.octet_length(data).cast("long") + 16
    rows = docs.select(docs[id_col].cast("long").alias("id"), size.alias("size"), F.crc32(data).alias("crc"), *[docs[c].cast("string").alias(f"l_{c}") for c in labels])
    dims = {"size": F.log2("size"), "id": F.col("id")} | {c: F.col(f"l_{c}") for c in labels}
    if target_bytes:
        shards = max(1, -(-int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // target_bytes))
    split = kd_shards(rows, F.col("size"), dims, "id", shards).select("row.id", "row.size", "row.crc", "shard")
    out = gapless(split, "shard", "id")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))

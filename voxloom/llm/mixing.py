"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed pseudo-random key. Sums of sizes by source and key bucket show in which bucket a
source's budget ends; only that bucket is looked at again, by its next key bits, until one key is left. The
mix is then a filter ``key <= threshold``: nothing is sorted, and nested budgets choose nested sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.llm.common import join_bounded, materialize, read, word_count

#: Bits of the key, and of one histogram.
KEY_BITS, STEP_BITS = 60, 12


def _key(id_col):
    """60 bits of the identifier's MD5; null identifiers share one key."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes(source, source_size)``, a row a source, with ``target`` added.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; no target
    exceeds ``most`` times its source's size, and what it leaves goes to the others by weight, until none is above.
    That fixed point is a water level: with sources ordered by cap for weight, the first one whose cap is not reached sets it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1)
    capped = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    done = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = capped.withColumn("left", share * F.sum("source_size").over(Window.partitionBy()) - done).withColumn("open_w", open_w)
    level = level.withColumn("fits", F.col("w") * F.col("left") / F.col("open_w") <= F.col("cap"))
    first = level.withColumn("pos", F.row_number().over(order)).withColumn("at", F.min(F.when(F.col("fits"), F.struct("pos", "left", "open_w"))).over(Window.partitionBy()))
    target = F.when(F.col("pos") >= F.col("at.pos"), F.col("w") * F.col("at.left") / F.col("at.open_w")).otherwise(F.col("cap"))
    return first.select("source", "source_size", target.alias("target"))


def _border_plan(rows: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """What each source takes, from written ``rows(source, size, key)``: ``p_source, source_size, target, base, threshold``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, float(most)), "targets")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # below: what keys under the searched prefix hold; prefix: key bits found so far
    search = targets.select("source", (F.col("target") - base * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    order = Window.partitionBy("source").orderBy("bucket")
    ended = []
    for used in range(STEP_BITS, KEY_BITS + 1, STEP_BITS):
        width = KEY_BITS - used
        near = join_bounded(rows, search, rows["source"].eqNullSafe(search["source"]), "inner").drop(search["source"])
        near = near.where(F.shiftright("key", width + STEP_BITS) == F.col("prefix"))
        sums = near.groupBy("source", "budget", "below", F.shiftright("key", width).alias("bucket")).agg(F.sum("size").alias("in_bucket"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = sums.withColumn("upto", F.col("below") + F.sum("in_bucket").over(order))
        found = upto.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", "budget", (F.col("upto") - F.col("in_bucket")).alias("below"), "in_bucket", "low", "high")).alias("x"))
        found = materialize(found.select("source", "x.*"), "border")
        ended.append(found.where("low = high"))
        search = found.where("low < high").select("source", "budget", F.col("bucket").alias("prefix"), "below")
        if not search.limit(1).count():
            break
    borders = reduce(DataFrame.unionByName, ended)
    takes_it = (F.col("below") + F.col("in_bucket") - F.col("budget")) < (F.col("budget") - F.col("below"))
    borders = borders.select(F.col("source").alias("b_source"), F.when(takes_it, F.col("low")).otherwise(F.col("low") - 1).alias("threshold"))
    return materialize(targets.join(borders, targets["source"].eqNullSafe(borders["b_source"]), "left").select(F.col("source").alias("p_source"), "source_size", "target", base.alias("base"), "threshold"), "plan")


def _times(most: int) -> Column:
    """How often a row is taken, from its ``key`` and its source's plan alone."""
    more = F.when(F.col("threshold").isNull(), F.col("target") > F.col("base") * F.col("source_size")).otherwise(F.col("key") <= F.col("threshold"))
    return F.least(F.col("base") + more.cast("long"), F.lit(most).cast("long"))


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return materialize(docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"), _key(docs[id_col]).alias("key")), "sizes")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, source_col, size, source_size, target, taken, times``.

    size: words (0 for a null or empty text). A source takes each document as often as its target holds the source whole,
    and once more those with the smallest keys up to the rest of the target; the document on the border is in if that
    brings the sum nearer (by half the border document's size at most). Null sources are one source. Rows
    repeated with one identifier share a key and go together within their source. Other columns are ignored; an empty table gives no rows.
    Keys depend on identifiers alone, so reruns agree and no document is taken more than ``most`` times.
    """
    rows = _keyed(docs, id_col, source_col, text_col)
    plan = _border_plan(rows, weights, share, most)
    out = join_bounded(rows, plan, rows["source"].eqNullSafe(plan["p_source"]), "inner").withColumn("times", _times(most))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mix_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows themselves: every row of ``docs`` as often as :func:`mix_sources` takes it, every column kept.

    A row finds its number of times by its own source and key, so rows repeated with one identifier, in one source or in
    several, and rows with a null identifier or source are each taken by themselves. An empty table gives no rows, and
    a source without any word has the target 0, so that none of its rows is taken.
    """
    plan = _border_plan(_keyed(docs, id_col, source_col, text_col), weights, share, most)
    rows = docs.select(docs[source_col].cast("string").alias("source"), _key(docs[id_col]).alias("key"), F.struct(*docs.columns).alias("row"))
    found = join_bounded(rows, plan, rows["source"].eqNullSafe(plan["p_source"]), "inner").select("row", _times(most).cast("int").alias("times"))
    return found.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("times")


SQL = {
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS pos FROM w),
l AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM o) - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM o),
f AS (SELECT pos, rest, open_w FROM l WHERE w * rest / open_w <= cap ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.pos >= f.pos THEN w * f.rest / f.open_w ELSE cap END AS target FROM l LEFT JOIN f ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
c AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       (size * least(2, base + CASE WHEN upto <= budget OR (upto - size < budget AND upto - budget < budget - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
}

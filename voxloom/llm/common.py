"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of bytes outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch sent to a Python worker; texts may be long, so batches stay short.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def join_bounded(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "left", max_rows: int = 100_000) -> DataFrame:
    """Join with a small written table: broadcast it if its counted rows are at most ``max_rows``, else let Spark shuffle.

    ``right`` must be cheap to count (a table from :func:`materialize`) and have narrow rows.
    """
    return left.join(F.broadcast(right) if right.limit(max_rows + 1).count() <= max_rows else right, on, how)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, component being the smallest node reachable.

    Alternating large-star and small-star rounds; every round is joins and grouped minima on written tables, so
    no task or driver holds a component. Null nodes are left out. The smallest neighbours are dealt anew for the join, by an
    expression that their grouping doesn't have, so that adaptive execution can split the links of a hot node.
    """

    def dealt(u: Column) -> Column:
        return u.bitwiseXOR(F.lit(1).cast("long"))

    def star(links: DataFrame, small: bool) -> DataFrame:
        both = links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        side = both.where("v <= u") if small else both.where("v > u")
        near = least.select(dealt(F.col("u")).alias("w"), "m")
        out = side.join(near, dealt(side["u"]) == near["w"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if small:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def digest(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = digest(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        links = materialize(star(star(links, False), True), "links")
        now = digest(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))

"""Tables written between the rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; a lost executor costs no recomputation of earlier rounds."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that no side's guessed size makes a broadcast: rows made by exploding, and packed files read back, are guessed too small."""
    return left.join(right.hint("merge"), list(on), how)


def numbered(df: DataFrame, order: str, place: str = "_i", total: str = "_n") -> DataFrame:
    """``df`` with each row's place by ``order``, from 0, and the number of rows.

    Rows are range-partitioned and numbered within their task; what earlier tasks hold is added from a table of one row
    per task. No task sees all rows, as a window over everything would.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged.withColumn("_task", F.shiftright("_at", 33)))
    tasks = ranged.groupBy("_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy()).alias(total))
    return ranged.join(shift, "_task").withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")

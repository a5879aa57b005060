"""Stores that are bucketed and sorted by volume, so that what is stored apart aligns without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int, by: Sequence[str] = ("uid",), order: Sequence[str] = ("uid",), mode: str = "error") -> DataFrame:
    """Write ``rows`` as the table ``name`` with its files in ``path``, one file a bucket of ``by``, sorted by ``order``; gives the table.

    Tables with equal ``by`` and as many buckets join and group by it, and by more columns besides, without a shuffle. A volume is in
    one bucket unless ``by`` has a part of its place, such as a tile's corner, too: give that where single volumes are large.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(buckets, *by).sortWithinPartitions(*order)
    dealt.write.bucketBy(buckets, *by).sortBy(*order).option("path", path).mode(mode).saveAsTable(name)
    return open_bucketed(spark, name)


def open_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """A bucketed table, in a session that uses buckets for joins on more columns than they are made by."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    return spark.table(name)

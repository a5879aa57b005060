import zlib

from pyspark.sql import functions as F

from tests.llm import cases
from voxloom.llm.sharding import gapless, kd_shards, shard_documents


def test_shards_are_even(spark):
    found = [(k, "w" * (1 + k * 37 % 900), "en", "hot" if k % 3 else f"s{k % 7}", 0, "", 0, "", 0.0, "", "", "") for k in range(1500)]
    got = shard_documents(cases.frame(spark, found).repartition(6), shards=7).collect()
    sizes, slots = {}, {}
    for r in got:
        text = found[r.doc_id][1]
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 3 * 916
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splits_follow_the_widest_dimension(spark):
    rows = spark.range(64).select("id", F.lit(1).alias("size"), (F.col("id") % 8).cast("double").alias("x"), F.lit(5.0).alias("y"))
    got = kd_shards(rows, F.col("size"), {"x": F.col("x"), "y": F.col("y")}, "id", 4).select("row.x", "shard").collect()
    assert {(r.x // 2, r.shard) for r in got} == {(k, k) for k in range(4)}


def test_awkward_rows(spark):
    got = shard_documents(cases.frame(spark), shards=3).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in cases.rows()] and {r.shard for r in got} <= {0, 1, 2}
    assert shard_documents(cases.empty(spark), shards=4).count() == 0
    assert shard_documents(cases.frame(spark), shards=1).select("shard").distinct().count() == 1
    same = [(1, "a", None, None, 0, "", 0, "", 0.0, "", "", "")] * 5 + [(None, None, None, None, 0, "", 0, "", 0.0, "", "", "")] * 2
    assert shard_documents(cases.frame(spark, same), shards=4).count() == 7


def test_slots_over_many_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("o"))
    got = gapless(df.repartition(8), "g", "o").collect()
    for g in (0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r.slot for r in own] == list(range(500))


def test_leaves_by_target_bytes(spark):
    rows = [(k, "w " * (1 + k % 50), "en", "s", 0, "", 0, "", 0.0, "", "", "") for k in range(2000)]
    got = shard_documents(cases.frame(spark, rows), target_bytes=9000).groupBy("shard").agg({"size": "sum"}).collect()
    total = sum(2 * (1 + k % 50) + 16 for k in range(2000))
    assert len(got) == -(-total // 9000) and max(r[1] for r in got) <= 9000 * 1.1

import base64
import gzip
import hashlib
import os

import pytest

from pyspark.sql import functions as F

from voxloom.llm.common import new_dir
from voxloom.llm.warc import copies_of, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, id long, sha string, kind int, payload string, best long"
PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/ d\r\nX: y", ""), (5, "http://é/", "é" * 1000), (6, "http://long/", "word " * 60_000), (7, "u", "<p>one</p>")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "s", 0, "p", 9) for r in rows], SCHEMA)


def brute(rows, least=0):
    out = set()
    for i, _, html in rows:
        data = (html or "").encode()
        best = max(j for j, _, h in rows if (h or "") == (html or ""))
        again = best != i and len(data) >= least
        out.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return out


def test_round_trip(spark):
    folder = new_dir(spark, "warc")
    write_archives(frame(spark, PAGES).repartition(3), folder)
    got = read_archives(spark, folder).collect()
    assert {(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(PAGES)
    for r in got:
        html = PAGES[r.id - 1][2] or ""
        assert r.payload == (None if r.record_type == "revisit" else html.encode())


def test_least_rolling_and_determinism(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 50}</p>" * 20) for k in range(200)]
    names, sums = [], []
    for partitions in (4, 4):
        folder = new_dir(spark, "warc")
        manifest = write_archives(frame(spark, rows).repartition(partitions, "page_id"), folder, least=161, roll_bytes=4000)
        root = folder.removeprefix("file://")
        files = sorted(f for f in os.listdir(root) if f.endswith(".warc.gz"))
        assert files == sorted(r.file for r in manifest.collect()) and len(files) > 8
        assert not [f for f in os.listdir(root) if f.startswith("_temporary")]
        names.append(files)
        sums.append({r.file: r.sha256 for r in manifest.collect()})
        for r in manifest.collect():
            with open(f"{root}/{r.file}", "rb") as f:
                data = f.read()
            assert hashlib.sha256(data).hexdigest() == r.sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        got = read_archives(spark, folder, payloads=False).collect()
        assert {(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows, 161)
    assert names[0] == names[1] and sums[0] == sums[1]


def test_nulls_and_repeats(spark):
    folder = new_dir(spark, "warc")
    write_archives(frame(spark, [(1, "a", "x"), (1, "a", "x"), (None, "n", "x"), (None, "n", "y"), (None, "m", "y")]), folder)
    got = sorted((str(r.id), r.record_type, r.refers_to) for r in read_archives(spark, folder).collect())
    assert got == [("1", "response", None), ("1", "revisit", 1), ("None", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_empty_and_damage(spark):
    folder = new_dir(spark, "warc")
    assert write_archives(frame(spark, []), folder).count() == 0 and read_archives(spark, folder).count() == 0
    folder = new_dir(spark, "warc")
    file = write_archives(frame(spark, PAGES[:1]), folder).first().file
    path = f"{folder.removeprefix('file://')}/{file}"
    with open(path, "rb") as f:
        data = gzip.decompress(f.read())
    with open(path, "wb") as f:
        f.write(gzip.compress(data.replace(b"<p>one", b"<p>two")))
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, folder).count()


def test_copies_of_one_payload_are_split(spark):
    """A third of all payloads equal: adaptive execution deals them to several tasks, and each copy is a revisit."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        slim = spark.range(0, n, 1, 8).select("id", F.sha2(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary"), 256).alias("sha"))
        marked = copies_of(slim)
        rows = marked.collect()
        assert len(rows) == n // 3 - 1 and {r.best for r in rows} == {n - 3}
        assert "skew=true" in marked._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

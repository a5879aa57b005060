"""Deterministic, sharded WARC archives.

Records are range-sorted by identifier. Every task streams its records to files that roll by compressed size, under
temporary names; a finished file is renamed to a name that depends on its place alone, so that a task that runs again
writes the same bytes to the same names. A manifest of finished files is written last and is what readers follow.
Headers, record identifiers and digests are regenerated from the data; nothing depends on the clock.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm.common import new_dir, read, short_batches

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_RECORD = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, i: int | None) -> str:
    """A header value: white space and control characters are percent-encoded; a null url names the row."""
    if not url:
        return f"urn:row:{i}"
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(i: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, revisit: bool, copy: int = 0) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's HTTP headers alone."""
    digest, uri = payload_digest(payload), _uri(url, i)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda row, k=0: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{row}/{digest}/{k}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(i, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"X-Row-ID: {'' if i is None else i}", f"X-Refers-To-Row-ID: {'' if refers_to is None else refers_to}", f"X-Has-URL: {int(bool(url))}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp, one for each record."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str, roll_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        out = at = None
        number, last, copies, mark = 0, None, 0, ()
        stats: list = []

        def close() -> pa.RecordBatch:
            nonlocal out, number
            out.close()
            final = f"part-{shard:06d}-{number:04d}.warc.gz"
            there = lambda: fs.get_file_info(f"{root}/{final}").type != pafs.FileType.NotFound
            if not there():
                try:
                    fs.move(at, f"{root}/{final}")
                except OSError:
                    if not there():
                        raise
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                fs.delete_file(at)  # another attempt's file stays: it has the same bytes
            out, number = None, number + 1
            n, size, digest, first, last = stats
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((final, n, size, digest.hexdigest(), first, last), _MANIFEST, strict=True)], schema=_MANIFEST)

        for batch in batches:
            for i, sha, kind, url, payload, best in zip(*(batch.column(c).to_pylist() for c in ("id", "sha", "kind", "url", "payload", "best")), strict=True):
                if kind == 0:
                    mark = (i, sha, best)
                    continue
                refers = mark[2] if mark[:2] == (i, sha) else None
                same = i is not None and (i, sha) == last  # repeated rows stand next to each other
                again = refers is None and same  # the first is the response
                copies = copies + again if same else 0
                last = (i, sha)
                refers = i if again else refers
                member = _member(record(i, url, payload, refers, date, again or refers is not None, copies if again else 0), level)
                if out is None:
                    at = f"{root}/_temporary-{shard:06d}-{number:04d}-{attempt}"
                    out, stats = fs.open_output_stream(at, compression=None), [0, 0, hashlib.sha256(), i, i]
                out.write(member)
                stats[0], stats[1], stats[4] = stats[0] + 1, stats[1] + len(member), i
                stats[2].update(member)
                if stats[1] >= roll_bytes:
                    yield close()
        if out is not None:
            yield close()

    return run


def copies_of(slim: DataFrame) -> DataFrame:
    """``(id, sha, best)`` of the rows ``(id, sha)`` whose payload a row with a larger identifier, ``best``, holds too.

    The best are dealt anew for the join, by a key that their grouping doesn't have, so that adaptive execution can split a hot payload.
    """
    best = slim.groupBy("sha").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1 AND best IS NOT NULL")
    dealt = best.select(F.reverse("sha").alias("dealt"), "best")
    return slim.join(dealt, F.reverse(slim["sha"]) == dealt["dealt"]).where(~F.col("id").eqNullSafe(F.col("best"))).select("id", "sha", "best")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, roll_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a WARC record per row to ``folder`` (a URI that all executors reach) and return the manifest.

    Of rows whose payloads of at least ``least`` bytes are equal, that with the largest identifier is the response and the others
    revisit it; of rows repeated with that identifier the first is the response. Null payloads are empty. Rows with a
    null identifier revisit where a real identifier holds the payload, else each is a response. Null urls become ``urn:row:``
    names. An empty table gives an empty manifest. Other columns are ignored.
    """
    short_batches(pages.sparkSession)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    slim = rows.where(F.octet_length("payload") >= least).select("id", "sha")
    # A narrow mark sorts right before the rows it makes revisits, so that payloads are shuffled once.
    marks = copies_of(slim).select("id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "best").distinct()
    both = rows.select("id", "sha", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("best")).unionByName(marks)
    ranged = both.repartitionByRange("id", "sha").sortWithinPartitions("id", "sha", "kind", "url")
    ranged.mapInArrow(_write(folder, roll_bytes, date, level), "file string, records long, bytes long, sha256 string, first_id long, last_id long").write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        fs, root = pafs.FileSystem.from_uri(folder)
        whole = lambda text: int(text) if text else None

        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                out = []
                with fs.open_input_stream(f"{root}/{file}", compression=None, buffer_size=1 << 20) as raw, gzip.open(raw) as stream:
                    for headers, block in parse(stream):
                        if headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
                            raise ValueError(f"{file}: a block does not match its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{file}: a payload does not match its digest")
                        refers = whole(headers["X-Refers-To-Row-ID"]) if kind == "revisit" else None
                        url = headers["WARC-Target-URI"] if headers["X-Has-URL"] == "1" else None
                        out.append((whole(headers["X-Row-ID"]), size, digest, kind, refers, url, payload if payloads and kind == "response" else None))
                        if len(out) >= 256:
                            yield table(out)
                            out = []
                if out:
                    yield table(out)

    return run


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the files that the manifest in ``folder`` names: ``id, payload_bytes, payload_digest, record_type, refers_to, url, payload``.

    Every digest is checked. Revisits have no payload of their own; their size and digest are the full payload's.
    """
    files = spark.read.parquet(f"{folder}/_manifest").select("file")
    files = files.repartition(max(1, min(files.count(), 4096)), "file")
    kinds = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return files.mapInArrow(_read(folder, payloads), kinds)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op3_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((((instr('0123456789abcdef', substr(hex, (1 + (5 * i) // 4)::INT, 1)) - 1) * 16
         + instr('0123456789abcdef', substr(hex, (2 + (5 * i) // 4)::INT, 1)) - 1)::INT >> (3 - (5 * i) % 4)::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM h
"""
}

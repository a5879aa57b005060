"""Exact deduplication by sorting content.

Sampled splitters range-partition the normalised bytes, Spark's external sort places equal ones next to each
other, and a streaming pass compares each text with its neighbour in full. Splitters hold at most a 64-byte
prefix, a digest and an identifier, so the driver's sample stays small however long the texts are; the
identifier is part of the order, so that a group of any size spreads over as many tasks as it fills. Runs that
cross task borders are joined by comparing the texts at the borders, which are fetched only where their digests agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.llm.common import join_bounded, materialize, read, short_batches

_RUNS = "id long, sha string, part int, run long, first boolean, last boolean, n long, low long, high long, head binary, tail binary"
_ARROW = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in content order become rows with the run they belong to; only the open run's identifiers are held."""
    part = TaskContext.get().partitionId()
    body = sha = None
    ids: list = []
    run, out = 0, []

    def close(last: bool) -> None:
        real = [i for i in ids if i is not None]
        low, high = (real[0], real[-1]) if real else (None, None)
        for k, i in enumerate(ids):
            out.append((i, sha, part, run, k == 0, k == len(ids) - 1, len(ids), low, high, body if run == 0 and k == 0 else None, body if last and k == 0 else None))

    def flush() -> pa.RecordBatch:
        table = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
        out.clear()
        return table

    for batch in batches:
        for i, b, s in zip(*(batch.column(c).to_pylist() for c in ("id", "body", "sha")), strict=True):
            if body is None or b != body:
                if body is not None:
                    close(False)
                    run += 1
                body, sha, ids = b, s, []
            ids.append(i)
        if len(out) >= 4096:
            yield flush()
    if body is not None:
        close(True)
    if out:
        yield flush()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    keep: ``smallest`` or ``largest`` identifier stays. normalise: a Column function applied to the text first.
    Null texts count as empty; empty texts are equal to each other. Rows repeated with one identifier count in
    group_size and exactly one of them is kept. A null identifier sorts below all others and stays only
    where nothing else can (``smallest`` prefers it, its keep_id is the smallest real one, if any). Other columns of
    ``docs`` are ignored, whatever their names; an empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    short_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), (normalise(text) if normalise else text).cast("binary").alias("body"))
    rows = rows.select("id", "body", F.substring("body", 1, 64).alias("prefix"), F.sha2("body", 256).alias("sha"))
    order = ["prefix", "sha", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "body", "sha")
    runs = materialize(ranged.mapInArrow(_runs, _RUNS), "runs")

    # The first and the last run of every task, and which of them continue the task before: where digests agree, texts are compared.
    ends = runs.where("first AND (head IS NOT NULL OR tail IS NOT NULL)")
    ends = ends.groupBy("part").agg(F.max(F.when(F.col("head").isNotNull(), F.col("sha"))).alias("head"), F.max(F.when(F.col("tail").isNotNull(), F.col("sha"))).alias("tail"), F.max("run").alias("last_run"))
    ordered = Window.orderBy("idx")
    idx = runs.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("idx"))
    ends = materialize(ends.join(idx, "part"), "ends")
    before = ends.select((F.col("idx") + 1).alias("idx"), F.col("tail").alias("prev_tail"), F.col("part").alias("prev_part"), F.col("last_run").alias("prev_run"))
    borders = materialize(ends.join(before, "idx", "left").select("idx", "part", "last_run", "prev_part", "prev_run", F.coalesce(F.col("head") == F.col("prev_tail"), F.lit(False)).alias("cont")), "borders")
    maybe = borders.where("cont").select("part", "prev_part")
    heads = runs.where("head IS NOT NULL").select("part", "head").join(maybe, "part")
    tails = runs.where("tail IS NOT NULL").select(F.col("part").alias("prev_part"), "tail")
    same = materialize(heads.join(tails, "prev_part").where(F.col("head") == F.col("tail")).select("part", F.lit(True).alias("same")), "same")
    chain = join_bounded(borders.drop("cont"), same, ["part"]).withColumn("cont", F.coalesce("same", F.lit(False))).drop("same")
    own = F.struct(F.col("part").alias("p"), F.lit(0).cast("long").alias("r"))
    start = F.when(~F.col("cont"), own).when(F.col("prev_run") > 0, F.struct(F.col("prev_part").alias("p"), F.col("prev_run").alias("r")))
    chain = chain.withColumn("chain", F.last(start, ignorenulls=True).over(ordered))
    chain = chain.select("part", F.lit(0).cast("long").alias("run"), "chain").unionByName(
        chain.where("last_run > 0").select("part", F.col("last_run").alias("run"), F.struct(F.col("part").alias("p"), F.col("last_run").alias("r")).alias("chain"))
    )
    edge_runs = runs.where("first AND (head IS NOT NULL OR tail IS NOT NULL)").select("part", "run", "n", "low", "high")
    pieces = materialize(chain.join(edge_runs, ["part", "run"]), "pieces")
    whole = pieces.groupBy("chain").agg(F.sum("n").alias("g_n"), F.min("low").alias("g_low"), F.max("high").alias("g_high"), F.min("part").alias("g_first"), F.max("part").alias("g_last"))
    fixes = materialize(pieces.join(whole.where("g_first < g_last"), "chain").select("part", "run", "g_n", "g_low", "g_high", "g_first", "g_last"), "fixes")

    out = join_bounded(runs.drop("head", "tail"), fixes, ["part", "run"])
    end = F.col("first") & (F.coalesce("g_first", "part") == F.col("part")) if keep == "smallest" else F.col("last") & (F.coalesce("g_last", "part") == F.col("part"))
    best = F.coalesce("g_low", "low") if keep == "smallest" else F.coalesce("g_high", "high")
    return out.select(F.col("id").alias(id_col), best.alias("keep_id"), F.coalesce("g_n", "n").alias("group_size"), end.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` drops, every column kept whatever its name.

    Rows repeated with one identifier and one text become one row. Null texts count as empty; a null identifier is
    kept like any other, as the smallest. An empty table gives no rows.
    """

    def key(i: Column, sha: Column) -> Column:
        return F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)

    kept = exact_duplicates(docs, id_col, text_col, keep).where("kept").select(key(F.col(id_col), F.col("text_sha256")).alias("key"))
    rows = docs.select(key(docs[id_col].cast("long"), F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"), keep="largest")


SQL = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
}

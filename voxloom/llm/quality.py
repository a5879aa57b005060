"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves a measurement and a failure bit. A policy is a version and
the rules it counts; applying one, or finding what each rule of it alone removes, only reads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.llm.common import read, short_batches

#: Rules by bit: a name, and the failing condition over the measurements.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("upper_case", "2 * n_upper > word_chars AND word_chars > 0"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("one_word", "5 * n_top_word > 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("stutter", "10 * n_same_next > 3 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_top_word", "n_same_next")
WINDOW = 8
_SPACE, _SYMBOLS, _UPPER = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91))


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(n for n, _ in RULES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int, int]:
    """Words that lie in a window of ``window`` words found twice or more, the count of the commonest word, and words equal to the one before."""
    if not words:
        return 0, 0, 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    top, stutter, n = int(np.bincount(ids).max()), int((ids[1:] == ids[:-1]).sum()), len(words) - window + 1
    if n < 2:
        return 0, top, stutter
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0, top, stutter
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    found: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(maybe):  # windows whose mixed values agree are compared in full
        found.setdefault(ids[k : k + window].tobytes(), []).append(k)
    cover = np.zeros(len(words) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            at = np.array(at)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum()), top, stutter


def _measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    repeat, top, stutter = repeated_words(words)
    return len(words), len(text) - gone(_SPACE), gone(_SYMBOLS), len(lines) - len(set(lines)), repeat, gone(_UPPER), len(lines), top, stutter


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_measures(t) for t in batch.column("text").to_pylist()]
        arrays = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the measurements, and ``failed`` with a bit for each rule that fails.

    A null text counts as empty: every measurement is 0 and of the rules only ``few_words`` fails. Repeated rows are
    judged each; null identifiers stay null. Other columns are ignored; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    measured = rows.mapInArrow(_measure, "id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = sum((F.when(F.expr(rule), 1 << bit).otherwise(0) for bit, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.select(F.col("id").alias(id_col), *MEASURES, failed.cast("long").alias("failed"))


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledgers: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, and those that it alone rejects.

    Only the counts of the distinct bit patterns are shuffled.
    """
    patterns = ledgers.groupBy("failed").count()
    rules = [(p.version, p.mask, n, 1 << b) for p in policies for b, (n, _) in enumerate(RULES) if n in p.rules]
    table = ledgers.sparkSession.createDataFrame(rules, "version string, mask long, rule string, bit long")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    counted = table.join(F.broadcast(patterns), F.lit(True), "left")  # at most 2 ** len(RULES) patterns
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    return counted.groupBy("version", "rule").agg(count(hit).alias("fails"), count(alone).alias("rejects_alone"))


def apply_policy(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, every column kept whatever its name; repeated rows stay repeated.

    A null text has no words, like an empty one, and is rejected by rules on the number of words; null identifiers are
    no matter. An empty table gives no rows. Bits travel with the row through one pass, so no join is needed.
    """
    short_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_measures(t) for t in batch.column(0).field(text_at).to_pylist()]
            arrays = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *MEASURES])

    text_at = names.index(text_col)
    kind = docs.select(F.struct(*names).alias("row")).schema["row"].dataType.simpleString()
    measured = docs.select(F.struct(*names).alias("row")).mapInArrow(run, f"row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = sum((F.when(F.expr(rule), 1 << bit).otherwise(0) for bit, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.where(passes(policy, failed.cast("long"))).select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(STRICT).alias("kept"), "failed")


SQL = {
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d),
y AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM x),
z AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM y) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM z) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
o AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, v, count(*) AS c FROM (SELECT doc_id, unnest(w) AS v FROM d) GROUP BY doc_id, v) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         coalesce(lines, 0)::BIGINT AS n_lines, coalesce(top, 0)::BIGINT AS n_top_word,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_same_next
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars AND word_chars > 0 THEN 8 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN 5 * n_top_word > 2 * n_words THEN 32 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END + CASE WHEN 10 * n_same_next > 3 * n_words THEN 128 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept, failed FROM f
"""
}

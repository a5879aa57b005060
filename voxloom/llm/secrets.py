"""Secret scans: three known shapes, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few characters a token on random strings and many on words of any language it has
seen. Long runs with letters are encoded, and those with few characters a token are secrets, unless they are digests, UUIDs or
words that the vocabulary knows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm.common import read, short_batches
from voxloom.llm.packing import ranks_encoder, vocabulary

#: Kinds in the order in which they are listed where two spans start together.
KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the three known shapes; matches that are too short are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs that the token-efficiency test looks at.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hexadecimal), UUIDs, and plain numbers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
#: Identifiers: words, each with a number at its end at most, joined by separators; their words, and a word's least letters a token.
IDENTIFIER = re.compile(r"[A-Za-z]+[0-9]{0,4}(?:[-_/+=]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[-_/+=]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD_LETTERS = 3.0
_RUN_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three known shapes as (start, end, kind), leftmost and non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in _RUN_HEX.finditer(text)]


def is_known(run: str, tokens: Callable[[str], int], most: float) -> bool:
    """Digests, UUIDs and identifiers of words with many letters a token are no secrets by themselves. A single word, all in
    capitals or not, has the letters a token that it has in lower case after a space."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return True
    if WORD.fullmatch(run):
        return len(run) > most * tokens(" " + run.lower())
    words = WORD.findall(run) if IDENTIFIER.fullmatch(run) else []
    return bool(words) and sum(map(len, words)) >= WORD_LETTERS * sum(tokens(" " + w.lower()) for w in words)


def random_spans(text: str, tokens: Callable[[str], int], most: float) -> list[tuple[int, int, str]]:
    """Runs of 16 or more characters with letters that have at most ``most`` characters a token."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if any(c.isalpha() for c in run) and len(run) <= most * tokens(run) and not is_known(run, tokens, most):
            found.append((m.start(), m.end(), "random"))
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(path: str, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ranks_encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                extra = random_spans(text or "", lambda s: len(encode(s)), most)
                for k in range(3):
                    out[k].append(sum(s[2] == KINDS[k] for s in base))
                out[3].append(len(extra))
                out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[5].append(_joined(base + extra))
            arrays = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, path: str, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    spans: ``kind:start:end`` in code points, end exclusive, by start and then kind. base_sha256 covers those of the three
    known shapes. most: characters a token up to which a run counts as random, under the vocabulary at ``path``.
    A null text counts as empty and has no spans; texts are scanned whole. Repeated rows are scanned each; null
    identifiers stay null. Other columns are ignored; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    found = rows.mapInArrow(_scan(path, most), "id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, path: str, most: float = 2.0, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text``: each text with every secret span replaced by ``mark``; overlapping spans become one mark, null stays null."""
    short_batches(docs.sparkSession)

    def clean(text: str | None, encode) -> str | None:
        if text is None:
            return None
        spans = sorted(s[:2] for s in base_spans(text) + random_spans(text, lambda s: len(encode(s)), most))
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ranks_encoder(path)
        for batch in batches:
            texts = pa.array([clean(t, encode) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts], names=["id", "text"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, text string").withColumnsRenamed({"id": id_col, "text": text_col})


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"), vocabulary())

"""Best-fit packing of tokenised documents into sequences.

Documents are tokenised in streaming tasks that keep only lengths and checksums. Pieces are packed online, best fit, in an
arbitrary but fixed order of arrival, with a fixed number of open bins per task: a bitset has a bit for each free space that
some open bin has, so the tightest bin that fits is the lowest set bit at or above the piece's length. When a bin must be
kept open beyond the bound, the fullest one closes first.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm.common import materialize, read, short_batches

#: Pieces that one packing task takes on average; each task leaves up to ``OPEN_BINS`` sequences unfilled.
PIECES_A_TASK = 200_000
#: Bins that a packing task holds open.
OPEN_BINS = 128
#: The vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}
_PIECES = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def ranks_encoder(path: str, special: dict[str, int] = SPECIAL) -> Callable[[str], np.ndarray]:
    """Text to ids by the ``tiktoken`` ranks file at ``path``; the same ids as :func:`json_encoder` with that vocabulary's file.

    Strings of ``special`` tokens in a text are these tokens; those that it leaves out are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")


def json_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by the ``tokenizers`` file at ``path``; the string of a special token in a text is that token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    return (ranks_encoder if path.endswith(".tiktoken") else json_encoder)(path)


def _cut(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for row, i, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text")), strict=True):
                ids = np.concatenate([encode(text), end])
                start, stop = 0, len(ids) % most or most
                for piece in range(-(-len(ids) // most)):
                    out.append((row, i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop = stop, stop + most
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def token_pieces(docs: DataFrame, path: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``most`` tokens, ``(row, id, piece, start, length, crc)``; ``row`` tells repeated rows apart.

    A document's ids end with ``end_id``, so an empty or null text is one piece of one token. Only documents longer than
    ``most`` are cut, and then all pieces but the first are full.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(path, end_id, most), "row long, id long, piece int, start long, length long, crc long")


class OpenBins:
    """At most ``bound`` open bins of ``size`` tokens. A bit of ``free`` is set for each free space that an open bin has."""

    def __init__(self, size: int, bound: int):
        self.size, self.bound, self.free, self.count, self.opened = size, bound, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        found = bins.pop()
        if not bins:
            self.free ^= 1 << space
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece and its offset there."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            at, space, self.opened = self.opened, self.size, self.opened + 1
        rest = space - length
        if rest and self.count >= self.bound:  # one more than may be open: the fullest closes, which may be this one
            least = (self.free & -self.free).bit_length() - 1
            if rest <= least:
                return at, self.size - space
            self._take(least)
        if rest:
            self.bins[rest].append(at)
            self.free |= 1 << rest
            self.count += 1
        return at, self.size - space


def _pack(most: int, bound: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = OpenBins(most, bound), TaskContext.get().partitionId() << 40
        for frame in frames:
            placed = np.array([bins.place(n) for n in frame["length"].tolist()], "int64").reshape(-1, 2)
            yield frame.assign(sequence_id=first + placed[:, 0], offset=placed[:, 1])

    return run


def pack(pieces: DataFrame, most: int = 1024, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (with ``row, piece, length``) with ``sequence_id`` and ``offset`` added, gapless in each sequence.

    Pieces are dealt to tasks at random and arrive in the order of a hash of their identity, whatever their lengths, so
    that a task that runs again packs alike. ``open_bins`` bounds what a task holds besides the piece at hand.
    """
    tasks = max(1, -(-pieces.count() // PIECES_A_TASK))
    dealt = pieces.withColumn("deal", F.xxhash64("id", "row", "piece")).repartition(tasks, "deal").sortWithinPartitions("deal", "row", "piece").drop("deal")
    return dealt.mapInPandas(_pack(most, open_bins), "row long, id long, piece int, start long, length long, crc long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, most: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts give one piece of one token. Repeated rows are packed each. Null identifiers stay null. Other
    columns are ignored; an empty table gives no rows. A piece's ids are its document's ids from ``start`` on, ``length`` of them.
    """
    packed = pack(materialize(token_pieces(docs, path, most, end_id, id_col, text_col), "pieces"), most, open_bins)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary())

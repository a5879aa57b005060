"""Ranked lexical search by dense blocked multiplication.

The terms of the items form a compact vocabulary. One pass turns every document into its counts of these terms; a second multiplies
tiles: item weights (items x vocabulary) times document impacts (vocabulary x documents), dense, in float64. Weights and
impacts are whole numbers, and a tile's vocabulary is cut so that no sum in it can reach 2^53; tiles are added as 64-bit integers.
A task keeps the ten best documents of each item and emits them at its end.

Items are a stated query set. They are broadcast in groups of bounded size, each of which meets every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxloom.llm.common import materialize, read, short_batches

#: Sides of the tiles: items, terms and documents.
ITEMS, TERMS, DOCS = 128, 2048, 256
#: Term occurrences of the items that are broadcast at once, each once an item.
GROUP = 1 << 16
#: Bytes of a text that separate terms become spaces, A-Z become a-z; bytes from 0x80 on are part of terms.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: maximal runs of ASCII letters, digits and all other characters from U+0080 on, A-Z in lower case."""
    return text.translate(_BYTES).split() if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = sorted(set(terms(text)))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])


def _counts(sent) -> Callable:
    """Per document: its number of terms, and numbers and counts of those that items hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(sent.value)}
        for batch in batches:
            sizes, ids, tfs, at = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                own = terms(text)
                sizes.append(len(own))
                known = [(k, n) for t, n in Counter(own).items() if (k := number.get(t)) is not None]
                ids += [k for k, _ in known]
                tfs += [n for _, n in known]
                at.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


def weight(n: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2 df + 1))) in doubles."""
    return int(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))))


def impacts(counts: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) of occurrences in documents of n terms; m = 10 + (90 n N) div L."""
    kinds, back = np.unique(n, return_inverse=True)
    m = np.array([10 + 90 * int(k) * docs // words for k in kinds], np.int64)[back]
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def tile_products(weights: np.ndarray, tile: np.ndarray, most: int = 1 << 53, width: int = TERMS) -> np.ndarray:
    """weights @ tile for whole numbers from 0 on, exact: the inner side is cut where a partial sum could reach ``most``."""
    bound = int(weights.max(initial=0)) * int(tile.max(initial=0))
    width = max(1, min(width, (most - 1) // bound)) if bound else width
    out = np.zeros((len(weights), tile.shape[1]), np.int64)
    for i in range(0, weights.shape[1], width):
        out += (weights[:, i : i + width] @ tile[i : i + width]).astype(np.int64)
    return out


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, identifiers and scores of the k best entries of each row that are above 0; of equal scores, smaller identifiers first."""
    if s.shape[1] > k:
        least = np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None], 1)
    else:
        least = np.ones((len(s), 1), np.int64)
    r, c = np.nonzero(s >= least)  # all that tie with the last one
    return cut(r, ids[c], s[r, c], k)


def cut(r: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row r."""
    order = np.lexsort((ids, -s, r))
    r, ids, s = r[order], ids[order], s[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], ids[keep], s[keep]


def dense_tiles(items: np.ndarray, numbers: np.ndarray, weights: np.ndarray, words: int) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Items' terms as tiles: first item, number of items, and for each cut of their compact vocabulary the place of every term in it (else -1) and the dense weights."""
    out = []
    for first in range(0, int(items.max()) + 1, ITEMS):
        own = (items >= first) & (items < first + ITEMS)
        known, local = np.unique(numbers[own], return_inverse=True)
        rows = min(ITEMS, int(items.max()) + 1 - first)
        parts = []
        for i in range(0, len(known), TERMS):
            place = np.full(words, -1)
            place[known[i : i + TERMS]] = np.arange(len(known[i : i + TERMS]))
            here = (local >= i) & (local < i + TERMS)
            dense = np.zeros((rows, len(known[i : i + TERMS])))
            dense[items[own][here] - first, local[here] - i] = weights[own][here]
            parts.append((place, dense))
        out.append((first, rows, parts))
    return out


def _rank(sent, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, numbers, weights, vocabulary, docs, words = sent.value
        tiles = dense_tiles(items, numbers, weights, vocabulary)
        held = [(np.zeros(0, np.int64),) * 3 for _ in tiles]
        least = [np.zeros(rows, np.int64) for _, rows, _ in tiles]
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                ids = part.column("doc_id").fill_null(_LAST).to_numpy()
                lengths = part.column("terms").value_lengths().to_numpy()
                col, row = np.repeat(np.arange(len(ids)), lengths), part.column("terms").flatten().to_numpy()
                value = impacts(part.column("counts").flatten().to_numpy().astype(np.int64), np.repeat(part.column("n").to_numpy(), lengths), docs, words)
                for t, (_, rows, parts) in enumerate(tiles):
                    s = np.zeros((rows, len(ids)), np.int64)
                    for place, dense in parts:
                        own = place[row]
                        known = own >= 0
                        tile = np.zeros((dense.shape[1], len(ids)))
                        tile[own[known], col[known]] = value[known]
                        s += tile_products(dense, tile)
                    hot = np.nonzero(s.max(1, initial=0) >= np.maximum(least[t], 1))[0]
                    if len(hot):
                        r, i, x = _top(s[hot], ids, k)
                        r, i, x = held[t] = cut(*(np.concatenate(both) for both in zip(held[t], (hot[r], i, x), strict=True)), k)
                        last = np.zeros(rows, np.int64)
                        last[r] = x  # the last one of each row remains
                        least[t] = np.where(np.bincount(r, minlength=rows) >= k, last, 0)
        for (first, _, _), (r, i, x) in zip(tiles, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(r + first, pa.int64()), pa.array(i, pa.int64()), pa.array(x, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _searched(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The result for one group of items of a bounded size."""
    spark = docs.sparkSession
    pairs = asked.collect()
    names = sorted({r.item_id for r in pairs}, key=lambda i: (i is None, i or 0))
    vocabulary = sorted({bytes(r.term) for r in pairs})
    if not pairs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    counts = materialize(docs.mapInArrow(_counts(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, counts array<int>"), "counts")
    n, words = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = {r.t: r.df for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # at most one row a term of the items
    number, place = {t: j for j, t in enumerate(vocabulary)}, {i: j for j, i in enumerate(names)}
    items, numbers = (np.array(x, np.int64) for x in ([place[r.item_id] for r in pairs], [number[bytes(r.term)] for r in pairs]))
    weights = np.array([weight(n, df.get(int(t), 0)) for t in numbers], np.int64)
    sent = spark.sparkContext.broadcast((items, numbers, weights, len(vocabulary), n, words))
    found = counts.where("size(terms) > 0").mapInArrow(_rank(sent, k), "item long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    named = F.broadcast(spark.createDataFrame([(j, i) for i, j in place.items()], "item long, item_id long"))
    return ranked.join(named, "item").select("item_id", "rank", F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", group: int = GROUP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents above 0 of each item, equal scores by ascending identifier.

    A null text, or one without terms, matches nothing and counts for nothing; texts are read whole. Rows repeated with one item identifier are
    one item that holds the terms of all, null identifiers too. Repeated documents count and rank each; a null identifier comes
    last among ties. Other columns are ignored; empty tables give no rows.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    asked = queries.select(queries[item_col].cast("long").alias("item_id"), queries[query_col].cast("binary").alias("text"))
    asked = asked.mapInArrow(_item_terms, "item_id long, term binary").distinct().withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)).cast("int"))
    asked = materialize(asked, "items")
    groups = max(1, -(-asked.count() // group))
    sizes = lambda: asked.groupBy(F.pmod("part", F.lit(groups))).count().agg(F.max("count")).first()[0]
    while 1 < groups < 1 << 20 and sizes() > 2 * group:
        groups *= 2
    out = _searched(texts, asked.where(F.pmod("part", F.lit(groups)) == 0), k)
    for g in range(1, groups):
        out = out.unionByName(materialize(_searched(texts, asked.where(F.pmod("part", F.lit(groups)) == g), k), "searched"))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = {
    "op11_lexical_search": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
m AS (SELECT doc_id, 10 + (90 * n * docs) // words AS m FROM d, g),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
}

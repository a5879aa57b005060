"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document is the set of its distinct word shingles, each as 64 bits. SuperMinHash gives every shingle a random
permutation of the slots, read one rank at a time; slot values of one shingle are correlated, which lowers the variance,
and a document stops as soon as no further rank can lower any slot, so long documents read few ranks.

Documents with equal sets are one class from the start. Classes that share a band meet in a bucket; buckets with the same
members are one. Every two classes of a bucket are compared on their full sets, unless links connect them already: first all
members with the bucket's leader, the class with most partners over all its buckets, then, in buckets that this leaves
in pieces, all members outside the largest piece with everyone. Comparisons happen in blocks of bounded size: askers visit
every block of those they ask. No pair of members is ever a row: blocks give only the links of a spanning forest, and
the same links hold whatever the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.llm.common import components, materialize, read, short_batches

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Words whose hashes a worker remembers, and shingles that are hashed together.
MEMO, CHUNK = 400_000, 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def set_name(values: np.ndarray) -> str | None:
    """The class of equal sets that a set belongs to; none for an empty set."""
    return xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit values."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        memo, words = self.memo, text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
        if len(memo) > MEMO:
            memo.clear()
        hashes = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            hashes[k] = h
        if not words:
            return hashes
        width = min(self.words, len(words))
        out = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            out = mix(out * _MIX[2] + hashes[k : k + len(out)])
        return np.unique(out)


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures of non-empty sets, a row each: slot s holds the least ``rank + r`` over the set's elements, where ``rank``
    is the place of s in the element's permutation and ``r`` in [0, 1) its draw at that rank.
    """
    out = np.full((len(sets), slots), np.inf)
    start = 0
    while start < len(sets):
        stop, n = start, 0
        while stop < len(sets) and (stop == start or n + len(sets[stop]) <= CHUNK):
            n += len(sets[stop])
            stop += 1
        if stop == start + 1 and n > CHUNK:  # a long document, in pieces: the least of their signatures
            whole = sets[start]
            for a in range(0, len(whole), CHUNK):
                _fill(out[start : start + 1], [whole[a : a + CHUNK]], slots)
        else:
            _fill(out[start:stop], sets[start:stop], slots)
        start = stop
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], slots: int) -> None:
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = np.concatenate(sets)
    perm = np.tile(np.arange(slots, dtype=np.int16), (len(seed), 1))
    at = np.arange(len(seed))
    for rank in range(slots):
        draw = mix(seed + np.uint64((rank + 1) * int(_MIX[2]) % (1 << 64)))
        pick = rank + ((draw >> np.uint64(40)) % np.uint64(slots - rank)).astype(np.int64)
        slot = perm[at, pick]
        perm[at, pick] = perm[at, rank]
        np.minimum.at(flat, owner * slots + slot, rank + (draw & np.uint64(0xFFFFFFFFFF)).astype(np.float64) * 2.0**-40)
        live = out.max(axis=1) > rank + 1  # a later rank can still lower a slot
        keep = live[owner]
        if not keep.all():
            owner, seed, at = owner[keep], seed[keep], at[keep]
        if not len(seed):
            break


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = [shingle(t) for t in texts]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [[] for _ in sets]
            if full:
                values = superminhash([sets[k] for k in full], bands * rows).view(np.uint64).reshape(len(full), bands, rows)
                joined = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(full), 1))
                for r in range(rows):
                    joined = mix(joined * _MIX[2] + values[:, :, r])
                for k, v in zip(full, joined.view(np.int64), strict=True):
                    keys[k] = v
            names = [set_name(s) for s in sets]
            room = [max(len(s), len(t) // 8) for s, t in zip(sets, texts, strict=True)]
            arrays = [batch.column("id"), batch.column("hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(room, pa.int64()), pa.array(names, pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "hash", "n", "room", "name", "keys"])

    return run


def local_links(sets: list[np.ndarray], group: np.ndarray, ask: np.ndarray, spared: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest's links among sets with ``100 * |a & b| >= percent * |a | b|``.

    group: component numbers known so far. Each member of ``ask`` (a mask) is compared with all sets outside its component,
    unless it has joined the component that ``spared`` marks: whoever is outside of that one asks somewhere, so every pair
    across components is seen by one of its sides.
    """
    sizes = np.array([len(s) for s in sets])
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(values), np.int32)
    _, group = np.unique(group, return_inverse=True)
    main, links = np.flatnonzero(spared)[:1], []
    for a in np.flatnonzero(ask):
        if (group[main] == group[a]).any():
            continue
        other = group != group[a]
        if not other.any():
            break
        own = where[starts[a] : starts[a] + sizes[a]]
        mark[own] = 1
        common = np.add.reduceat(mark[where], starts)
        mark[own] = 0
        for b in np.flatnonzero((100 * common >= percent * (sizes + sizes[a] - common)) & other):
            if group[b] != group[a]:
                links.append((a, b))
                group[group == group[b]] = group[a]
    return links


_VISIT = ("unit", "block", "part", "id", "hash", "component", "ask", "main")


def _visit(words: int, percent: int):
    """Links among the rows of each (unit, block, part); rows arrive sorted by these, and one group is held at a time."""

    def links(rows: dict[tuple, list], shingle: Shingler) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        ids = [i for i, _ in rows]
        component, ask, main, texts = zip(*rows.values(), strict=True)
        found = local_links([shingle(t) for t in texts], np.array(component), np.array(ask), np.array(main), percent)
        return [(ids[a], ids[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, at, held, out = Shingler(words), None, {}, []
        for batch in batches:
            for unit, block, part, i, h, component, ask, main, text in zip(*(batch.column(c).to_pylist() for c in (*_VISIT, "text")), strict=True):
                if (unit, block, part) != at:
                    out += links(held, shingle)
                    at, held = (unit, block, part), {}
                if (i, h) in held:  # one that asks in its own block, or a repeated row
                    held[i, h][1] |= ask
                else:
                    held[i, h] = [component, ask, main, text]
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        out += links(held, shingle)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _own(salt: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64("id", "hash", "unit", F.lit(salt)), F.col(blocks).cast("long")).cast("int")


def _every(blocks: str) -> Column:
    return F.sequence(F.lit(0), F.col(blocks) - 1)


def _with_unit(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` with their unit's columns; units are dealt anew, so that adaptive execution can split a unit of many rows."""
    units = units.withColumn("dealt", F.col("unit").bitwiseXOR(F.lit(1).cast("long"))).drop("unit")
    return rows.join(units, rows["unit"].bitwiseXOR(F.lit(1).cast("long")) == units["dealt"]).drop("dealt")


def _blocks(room: Column, block_shingles: int) -> Column:
    return F.ceil(F.sum(room) / block_shingles).cast("int")


def _star_visits(stars: DataFrame, block_shingles: int) -> DataFrame:
    """Each member of ``stars(unit, leader, member)`` visits one block of its unit; the leader visits all of them and asks."""
    sizes = stars.groupBy("unit").agg(_blocks(F.col("member.room"), block_shingles).alias("blocks"), F.first("leader").alias("leader"))
    members = _with_unit(stars.select("unit", "member.id", "member.hash"), sizes.select("unit", "blocks")).withColumn("block", _own("block", "blocks")).withColumn("ask", F.lit(False))
    leaders = sizes.select("unit", "leader.id", "leader.hash", F.explode(_every("blocks")).alias("block"), F.lit(True).alias("ask"))
    both = members.select(leaders.columns).unionByName(leaders)
    return both.select("unit", "block", F.lit(0).alias("part"), "id", "hash", F.col("id").alias("component"), "ask", F.lit(False).alias("main"))


def _grid_visits(rows: DataFrame, block_shingles: int) -> DataFrame:
    """Members of ``rows(unit, id, hash, room, component)`` outside their unit's largest component ask in every block, in parts of bounded size."""
    sizes = rows.groupBy("unit", "component").agg(F.count("*").alias("members"), F.sum("room").alias("room"))
    largest = F.struct("members", "component")
    units = sizes.groupBy("unit").agg(
        F.max_by("component", largest).alias("largest"), _blocks(F.col("room"), block_shingles).alias("blocks"), F.ceil((F.sum("room") - F.max_by("room", largest)) / block_shingles).cast("int").alias("parts")
    )
    rows = _with_unit(rows, units.where("parts > 0"))
    main = F.col("component") == F.col("largest")
    asks = F.transform(F.when(main, F.array().cast("array<int>")).otherwise(_every("blocks")), lambda b: F.struct(b.alias("block"), _own("part", "parts").alias("part"), F.lit(True).alias("ask")))
    told = F.transform(_every("parts"), lambda p: F.struct(_own("block", "blocks").alias("block"), p.alias("part"), F.lit(False).alias("ask")))
    return rows.select("unit", "id", "hash", "component", main.alias("main"), F.inline(F.concat(told, asks))).select(*_VISIT)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 6, block_shingles: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Texts are whole; A-Z count as lower case; words are runs without ASCII white space. A text with fewer than ``words``
    words is one shingle; null and empty texts have none and are linked with nothing. Documents are linked where
    ``100 * |a & b| >= percent * |a | b|`` on the full sets and a band is equal; component_id is the smallest identifier
    reachable. Two documents at 80 percent are missed by all 50 bands of 6 slots with a probability below 3e-7, and by fewer
    bands the more documents they are linked through. Rows repeated with an identifier are one node.
    Null identifiers form rows of their own, with a null component and kept true. Other columns are ignored; an empty table gives no rows.
    block_shingles bounds what a task holds besides one document, and changes nothing in the result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("hash"), "text")  # the hash tells texts of one identifier apart
    signed = materialize(texts.mapInArrow(_sign(words, bands, rows), "id long, hash long, n long, room long, name string, keys array<long>"), "signed")

    # Classes of equal sets, by their smallest identifier.
    classes = signed.where("name IS NOT NULL AND id IS NOT NULL").groupBy("name").agg(F.min(F.struct("id", "hash", "room", "keys")).alias("x"))
    classes = materialize(classes.select("name", "x.*"), "classes")

    # One bucket for every set of two or more classes that share a band.
    keys = classes.select(F.explode("keys").alias("bucket"), "id", "hash", "room")
    sets = keys.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id", "hash")).alias("x"), F.bit_xor(F.xxhash64("hash", "id", F.lit(1))).alias("y")).where("members > 1")
    sets = sets.groupBy("members", "x", "y").agg(F.min("bucket").alias("bucket"))
    meets = materialize(keys.join(sets.select("bucket", "members"), "bucket"), "meets")

    def links(visits: DataFrame) -> DataFrame:
        order = ["unit", "block", "part"]
        dealt = visits.join(texts.where("id IS NOT NULL"), ["id", "hash"]).repartition(*order).sortWithinPartitions(*order)
        return materialize(dealt.mapInArrow(_visit(words, percent), "a long, b long"), "edges")

    # Everyone is compared with the leader of each of its buckets.
    degrees = meets.groupBy("id", "hash").agg(F.sum("members").alias("degree"))
    member = F.struct("id", "hash", "room").alias("member")
    ranked = materialize(meets.join(degrees, ["id", "hash"]).select("bucket", "degree", member), "ranked")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("degree", F.bitwise_not("member.id").alias("low"), "member")).alias("x"))
    leaders = materialize(leaders.select(F.col("bucket").alias("unit"), F.col("x.member").alias("leader")), "leaders")
    followers = _with_unit(ranked.select(F.col("bucket").alias("unit"), "member"), leaders).where("member <> leader")
    followers = materialize(followers, "followers")
    stars = followers.select(F.xxhash64("leader.id", "leader.hash").alias("unit"), "leader", "member").distinct()
    edges = links(_star_visits(materialize(stars, "stars"), block_shingles))
    reached = components(edges)

    # Buckets that are still in pieces: everyone outside the largest piece is compared with everyone.
    named = followers.select("unit", "member.*").join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialize(named, "members")
    open_ = named.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("unit")
    rest = materialize(_with_unit(named, open_), "rest")
    if rest.limit(1).count():
        edges = edges.unionByName(links(_grid_visits(rest, block_shingles)))
        reached = components(edges)

    named = classes.select("name", "id").join(reached.withColumnRenamed("node", "id"), "id", "left").select("name", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n", "name").join(named, "name", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one document of each group, every column kept whatever its name.

    Rows repeated with a kept identifier, and rows with a null one, all stay.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col(id_col).alias("key")).distinct()
    rows = docs.select(docs[id_col].cast("long").alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(kept, rows["key"].eqNullSafe(kept["key"]), "left_semi").select("row.*")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS name, g FROM g),
c AS (SELECT name, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM s WHERE n > 0 GROUP BY name),
x AS (SELECT id, n, unnest(g) AS v FROM c),
f AS (SELECT v, count(*) AS df FROM x GROUP BY v),
-- two sets at 80 percent share one of each one's rarest fifth of shingles, plus one
r AS (SELECT id, n, x.v, row_number() OVER (PARTITION BY id ORDER BY df, x.v) AS k FROM x JOIN f USING (v)),
p AS (SELECT id, n, v FROM r WHERE k <= n - ceil(0.8 * n) + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.v = b.v AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT q.a, q.b, q.an, q.bn, count(*) AS i FROM q JOIN x xa ON xa.id = q.a JOIN x xb ON xb.id = q.b AND xb.v = xa.v GROUP BY ALL) WHERE 100 * i >= 80 * (an + bn - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT id AS node, id AS root FROM c UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
m AS (SELECT node, min(root) AS component FROM t GROUP BY node)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.name = c.name AND s.n > 0 LEFT JOIN m ON m.node = c.id
"""
}

import math
import random

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import hardneg
from voxloom.llm.hardneg import Heaps, best, hard_negatives, op12_hard_negatives, scores, strassen

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row int, place int, score string, v string, rank int"


def brute(found, anchor, k=5, low=80, high=100):
    rows = []
    for vec_id, v, label, *_ in found:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out, seen = [], set()
    for a, va, la in sorted((r for r in rows if r[0] is not None and anchor(r[0])), key=lambda r: (r[0], r[2], r[1])):
        if (a, la) in seen:
            continue
        seen.add((a, la))
        scored = [(sum(x * y for x, y in zip(va, v)), i, label == la) for i, v, label in rows if i != a]
        for p, pid, _ in sorted((t for t in scored if t[2]), key=order)[:k]:
            near = sorted((t for t in scored if not t[2] and low * p <= 100 * t[0] <= high * p), key=order)[:k]
            out += [(a, pid, rank, n, p, s) for rank, (s, n, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives(df, F.col("id") % 20 == 0, label=label, **options).collect()), key=repr)


def vectors(seed, n, dims=12):
    rng = random.Random(seed)
    hot = [0.5] * dims
    out = []
    for k in range(n):
        v = hot if k % 3 == 0 else [float(np.float32(rng.choice((0.25, 0.5, 1.0, -1.0)) * rng.random())) for _ in range(dims)]
        out.append((k, v, k % 4))
    out += [(n, None, 1), (n + 1, hot, None), (n + 2, [*hot[1:], float("nan")], 1), (n + 3, [*hot[1:], float("-inf")], 1), (n + 4, [*hot[1:], None], 1), (n + 5, [], 1), (n + 6, hot[:3], 2), (n + 7, [*hot, 1.0], 2), (None, hot, 1), (None, hot, 2), (21, hot, 1), (21, hot, 1), (20, hot, 0), (20, hot, 0)]
    return [(*r, 7, 1, None, "s", "v", 3) for r in out]


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (2, 3, 5), (7, 1, 9), (33, 17, 65), (64, 64, 64), (0, 4, 3), (3, 0, 2), (129, 40, 31)):
        for leaf in (1, 64, 1 << 18):
            a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
            assert (strassen(a, b, leaf) == a @ b).all() and strassen(a, b, leaf).dtype == np.int64


def test_long_products_and_padding():
    big = np.array([[1 << 40, 5], [-(1 << 40), 3]], np.int64)
    assert scores(big, np.array([[1 << 40], [1]])).tolist() == [[2**63 - 2, 1 << 40], [-(2**63) + 1, -(1 << 40)]]
    assert scores(np.array([[1, 2, 3]]), np.array([[4, 5], [0, 1]])).tolist() == [[14, 2]]


def test_heaps_merge_and_keep_ties():
    rng = random.Random(2)
    for _ in range(30):
        s = np.array([[rng.randrange(4) for _ in range(40)] for _ in range(6)])
        cols, found = best(s, 5)
        for r in range(6):
            assert sorted(zip(-found[r], cols[r])) == sorted((-x, c) for c, x in enumerate(s[r]))[:5]
        whole, ids = Heaps(6, 5), np.arange(40)
        cuts = [ids[np.isin(ids % 3, g)] for g in ((2,), (0, 1))]
        for c in cuts:
            whole.offer(slice(0, 6), s[:, c], c)
        for r in range(6):
            assert list(zip(-whole.score[r], whole.id[r])) == sorted((-x, c) for c, x in enumerate(s[r]))[:5]


def test_against_brute_force(spark):
    found = vectors(5, 240)
    want = brute(found, lambda i: i % 20 == 0)
    df = spark.createDataFrame(found, SCHEMA)
    assert mined(df) == want and len(want) > 40
    assert mined(df.repartition(7), group=40) == want  # anchors in many groups
    found = vectors(6, 90, 4)
    assert mined(spark.createDataFrame(found, SCHEMA), negatives=3, positives=3) == brute(found, lambda i: i % 20 == 0, 3)


def test_empty_table_and_query(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert mined(df) == []
    found = [(100 * k, [1.0, float(k)], k % 2) for k in range(8)] + [(k, [0.5, k / 8], k % 3) for k in range(1, 60)]
    spark.createDataFrame(found, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(found, lambda i: i % 100 == 0)
    assert hardneg.ANCHORS * hardneg.CANDIDATES * 8 < 16 << 20  # one tile of scores

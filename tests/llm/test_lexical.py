import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm import cases
from voxloom.llm.lexical import cut, search, terms, tile_products

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    split = lambda t: TERM.findall(cases.lower(t))
    own = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for (d, c), size in zip(own, sizes, strict=True):
            m = 100 - 90 + 90 * size * n // words if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 1, 2.0) for r in docs], "doc_id long, text string, item string, n int, score double")
    i = spark.createDataFrame([(*r, "x", 1, 2.0) for r in items], "item_id long, text string, part string, term int, rank double")
    return sorted((tuple(r) for r in search(d, i, **options).collect()), key=repr)


def test_terms():
    for text in ("", "Ab-c_1É é\u00a0x\u2028y\x85z\t0~", "ÀÉ AZ@[`{", "a" * 5000):
        assert [t.decode() for t in terms(text.encode())] == TERM.findall(cases.lower(text))
    assert terms(None) == []


def test_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(r[0], r[1]) for r in cases.rows()] + [(1000 + k, cases.prose(rng, rng.randint(1, 60), 40)) for k in range(150)] + [(None, "one two"), (None, "one two"), (3, "one two one")]
    docs += [(2000 + k, "tie word") for k in range(40)]
    items = [(k, cases.prose(rng, 12, 40)) for k in range(30)]
    items += [(50, "one two line extra"), (51, None), (52, ""), (53, "tie"), (53, "word ÉÉ"), (None, "same a b"), (54, "absentterm"), (55, "ONE one One")]
    want = brute(docs, items)
    assert len(want) > 60 and got(spark, docs, items) == want
    assert got(spark, docs, items, group=60) == want  # items in several groups
    assert got(spark, docs, items, k=3) == brute(docs, items, 3)


def test_many_items_and_terms_over_tiles(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(f"w{rng.randrange(6000)}" for _ in range(80))) for k in range(600)]
    items = [(k, " ".join(f"w{rng.randrange(6000)}" for _ in range(40))) for k in range(150)]
    assert got(spark, docs, items) == brute(docs, items)


def test_products_stay_exact_and_cuts_keep_ties():
    rng = np.random.default_rng(3)
    w, d = rng.integers(0, 30_000, (9, 700)).astype(float), rng.integers(0, 1_000_000, (700, 40)).astype(float)
    want = w.astype(object) @ d.astype(object)
    for most in (1 << 53, 1 << 36, 2):
        assert (tile_products(w, d, most) == want).all()
    big = np.full((2, 4096), 2.0**30)
    assert (tile_products(big, np.full((4096, 3), 999_999.0)) == 4096 * 2**30 * 999_999).all()
    r, i, s = cut(np.array([0, 1, 0, 0]), np.array([9, 1, 3, 5]), np.array([4, 7, 4, 4]), 2)
    assert (r.tolist(), i.tolist(), s.tolist()) == ([0, 0, 1], [3, 5, 1], [4, 4, 7])


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [(1, None), (2, "-")], [(1, "a")]) == []

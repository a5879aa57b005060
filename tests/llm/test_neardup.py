import random

import numpy as np

from tests.llm import cases
from voxloom.llm.common import components
from voxloom.llm.neardup import drop_near_duplicates, local_links, near_duplicates, superminhash


def shingles(text, k):
    w = cases.words(cases.lower(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(found, k):
    sets = {r[0]: shingles(r[1], k) for r in found}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(i, len(sets[i]), top(i), top(i) == i) for i in ids}


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = cases.prose(rng, 1)
    return " ".join(w)


def corpus(seed=3):
    rng = random.Random(seed)
    out = [r[:2] for r in cases.rows()]
    for _ in range(12):
        text = cases.prose(rng, rng.choice((15, 60, 150)))
        out += [(len(out) + k, edited(rng, text, rng.randrange(0, 6))) for k in range(rng.randrange(2, 9))]
    return [(i, *r[1:]) for i, r in enumerate(out)]


def test_against_brute_force(spark):
    found = corpus()
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(5)
    for k in (2, 5):
        assert {tuple(r) for r in near_duplicates(df, words=k).collect()} == brute(found, k)


def test_blocks_do_not_matter(spark):
    """A family far above the block size, many of whose pairs are not links: the same links at any block size."""
    rng = random.Random(5)
    text = cases.prose(rng, 80)
    found = [(k, edited(rng, text, rng.randrange(0, 9))) for k in range(120)]
    df = spark.createDataFrame(found, "doc_id long, text string")
    for size in (600, 1 << 16):
        assert {tuple(r) for r in near_duplicates(df, words=2, block_shingles=size).collect()} == brute(found, 2)
    few = [{tuple(r) for r in near_duplicates(df, words=2, bands=3, block_shingles=size).collect()} for size in (300, 2000, 1 << 16)]
    assert few[0] == few[1] == few[2]
    # what few bands find are links: their components lie within the true ones
    true = {i: c for i, _, c, _ in brute(found, 2)}
    assert all(true[i] == true[c] for i, _, c, _ in few[0])


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(base[:300]), np.unique(base[60:360])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = superminhash([a, b], 300)
    assert abs((s[0] == s[1]).mean() - true) < 0.1
    long = np.unique(rng.integers(0, 2**63, 80_000, dtype=np.uint64))
    assert np.array_equal(superminhash([long], 64), np.minimum(superminhash([long[:50_000]], 64), superminhash([long[50_000:]], 64)))
    assert (np.sort(superminhash([a[:1]], 64)[0].astype(int)) == np.arange(64)).all()  # one element's ranks are a permutation


def test_local_links_skip_only_what_is_linked():
    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64), np.arange(501, 601, dtype=np.uint64)]
    none, all_ = np.zeros(4, bool), np.ones(4, bool)
    assert {tuple(sorted(x)) for x in local_links(sets, np.arange(4), all_, none, 80)} == {(0, 1), (2, 3)}
    assert local_links(sets, np.array([0, 0, 1, 1]), all_, none, 80) == []
    assert local_links(sets, np.arange(4), np.array([True, False, False, False]), none, 80) == [(0, 1)]


def test_local_links_ask_a_majority():
    """Rows that ask outnumber those that are told of, and one pair across joins the two components."""
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 10, 15, 20)] + [np.arange(5000, 5100, dtype=np.uint64)]
    ask, group = np.array([True, True, True, False, False, False]), np.array([0, 0, 0, 1, 1, 1])
    assert local_links(sets, group, ask, ~ask, 80)
    assert local_links(sets, np.array([0, 0, 0, 0, 0, 1]), np.array([True, True, False, False, False, True]), np.array([False] * 2 + [True] * 3 + [False]), 80) == []
    # told rows of both components: an asked one still meets the other's
    assert local_links(sets, group, np.array([False, False, True, False, False, False]), np.array([True, True, False, False, False, False]), 80) == []
    assert local_links(sets, group, np.array([False, False, True, False, False, False]), np.zeros(6, bool), 80)


def test_components(spark):
    """Long paths, hubs and repeated edges, against a plain search."""
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(3, 3), (401, 400), (401, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w"), (7, "x y z u v w"), (3, None), (4, "")], "doc_id long, text string")
    got = near_duplicates(df)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(None, None), (1, 1), (7, 1), (3, 3), (4, 4)}
    kept = drop_near_duplicates(cases.frame(spark), words=2)
    assert kept.columns == cases.frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in brute([r[:2] for r in cases.rows()], 2) if k}

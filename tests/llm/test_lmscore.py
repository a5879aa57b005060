import math
import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from voxloom.llm import lmscore
from voxloom.llm.packing import vocabulary


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([r[:2] for r in cases.rows()], "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return cases.by_id(lmscore.language_scores(df, held, vocabulary()))


def test_base_against_brute_force(scored):
    found = {r[0]: [*cases.words(cases.lower(r[1])), None] for r in cases.rows()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in found}
    counts = Counter(w for i, ws in found.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in found.items():
        r = scored[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def some_classes(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 100, lmscore.IDS).astype(float)
    return lmscore.make_classes(counts, rng.integers(0, 5, lmscore.IDS * lmscore.COMPANY).astype(float), np.argsort(-counts, kind="stable"), lmscore.word_openers(vocabulary()))


@pytest.fixture(scope="module")
def classes():
    return some_classes()


def random_blocks(classes, rng, sizes, skip=None):
    ids = rng.integers(0, lmscore.IDS, sum(sizes)).astype(np.uint16)
    return lmscore.blocks_of(ids, np.array(sizes), np.array(skip or [0] * len(sizes)), classes)


def test_probabilities_sum_to_one(classes):
    leaves = lmscore.ROWS
    assert set(classes.of) == set(range(leaves))
    assert np.allclose(np.bincount(classes.of, 10**classes.share), 1, rtol=1e-9)
    p = lmscore.unpack(lmscore.first_parameters(classes))
    b = random_blocks(classes, np.random.default_rng(1), [3 + lmscore.SPAN + 5])
    sums = np.zeros(b.mask.shape)
    for k in range(leaves):
        sums += 10 ** lmscore.log10_probabilities(p, b, np.full(b.mask.shape, k)) * b.mask
    assert np.allclose(sums[b.mask], 1, atol=1e-4)


def plain_scores(flat, classes, ids):
    """A text's score one id at a time, from float64 vectors of the ids that its window sees."""
    p = {k: v.astype(np.float64) for k, v in lmscore.unpack(flat).items()}
    line, total = [lmscore.END] * 3 + list(map(int, ids)), 0.0
    leaf = classes.of[np.array(line)]
    inputs = [p["emb"][leaf[t + 2]] + p["one"][leaf[t + 1]] + p["two"][leaf[t]] for t in range(len(ids))]
    seen = []
    for t, target in enumerate(ids):
        begin = max(t // lmscore.SPAN - 1, 0) * lmscore.SPAN
        seen.append(t - begin)
        q, k, v = np.split(np.array(inputs[begin : t + 1]) @ p["qkv"], 3, axis=1)
        a = np.exp(k @ q[-1] / np.sqrt(lmscore.WIDTH) + p["near"][t - np.arange(begin, t + 1)])
        h1 = inputs[t] + (a / a.sum()) @ v @ p["wo"]
        h = h1 + np.maximum(h1 @ p["w1"] + p["b1"], 0) @ p["w2"]
        group, place = divmod(int(classes.of[target]), lmscore.LEAVES)
        for z, at in ((h @ p["out"] + p["bias"], group), (h @ p["leaf"][group] + p["leaf_bias"][group], place)):
            total += (z[at] - np.log(np.exp(z).sum())) / np.log(10)
        total += classes.share[target]
    return total, seen


def test_scores_against_one_id_at_a_time(classes, monkeypatch):
    """Texts of all lengths, over borders of windows and of batches; what stands beside a text doesn't matter."""
    flat, rng, span = lmscore.first_parameters(classes), np.random.default_rng(2), lmscore.SPAN
    texts = [rng.integers(0, lmscore.IDS, n).astype(np.uint16) for n in (1, 2, span - 1, span, span + 1, 3 * span, 7 * span + 3, 1)]
    monkeypatch.setattr(lmscore, "CHUNK", 3)
    together = lmscore.sequence_scores(lmscore.unpack(flat), np.concatenate(texts), np.array(list(map(len, texts))), classes)
    want = [plain_scores(flat, classes, t)[0] for t in texts]
    assert np.allclose(together, want, rtol=1e-5, atol=1e-4) and (together < 0).all()
    seen = plain_scores(flat, classes, texts[6])[1]
    assert all(min(t, span) <= n < 2 * span for t, n in enumerate(seen))


def test_context_reaches_earlier_words(classes):
    """On texts of ordinary and of long words, over 90 percent of the ids after the first see ids of an earlier word, and an earlier word changes scores."""
    lexicon, rng = lmscore.Lexicon(vocabulary()), np.random.default_rng(4)
    words = [b"%s" % bytes(rng.integers(97, 123, rng.integers(1, 14)).astype(np.uint8)) for _ in range(400)] + [b""]
    at, _ = lexicon.numbers(words)
    ids, ends = lexicon.spelled(at)
    begins = np.repeat(ends - lexicon.size[at], lexicon.size[at])
    seen_from = np.maximum(np.arange(len(ids)) // lmscore.SPAN - 1, 0) * lmscore.SPAN
    assert (seen_from < begins)[1:].mean() > 0.9
    p, other = lmscore.unpack(lmscore.first_parameters(classes)), ids.copy()
    other[3] = (int(other[3]) + 977) % lmscore.IDS
    one, two = (lmscore.log10_probabilities(p, b, classes.of[b.target]) for b in (lmscore.blocks_of(np.concatenate([[lmscore.END] * 3, x]).astype(np.uint16), np.array([len(x) + 3]), np.array([0]), classes) for x in (ids, other)))
    changed = np.flatnonzero(~np.isclose(one, two, atol=1e-6))
    assert changed.min() == 3 and 2 * lmscore.SPAN - 4 < changed.max() < 2 * lmscore.SPAN


def test_gradient(classes):
    flat = lmscore.first_parameters(classes).astype(np.float64)
    flat[-2000:] += 0.01
    b = random_blocks(classes, np.random.default_rng(3), [3 + 5, 3 + 2 * lmscore.SPAN + 7, 3 + lmscore.SPAN + 4], [0, 0, lmscore.SPAN])
    leaf = classes.of[b.target]
    g, loss = lmscore.gradient(lmscore.unpack(flat), b, leaf)
    assert np.isclose(loss, -np.log(10) * lmscore.log10_probabilities(lmscore.unpack(flat), b, leaf).sum())
    start = 3 * lmscore.ROWS * lmscore.WIDTH
    some = [n * lmscore.ROWS * lmscore.WIDTH + int(b.rows[n, 2, 1]) * lmscore.WIDTH + 1 for n in range(3)]
    near = start + 4 * lmscore.WIDTH**2
    for k in [*some, near, near + 1, near + lmscore.SPAN + 2, *range(start, len(flat), 271)]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        slope = (lmscore.gradient(lmscore.unpack(up), b, leaf)[1] - lmscore.gradient(lmscore.unpack(down), b, leaf)[1]) / 2e-4
        assert abs(slope - g[k]) < 1e-4


def test_ids_of_words():
    """Encoded together, words have the ids that each has alone."""
    subwords, encode = lmscore.Subwords(vocabulary()), lmscore.ranks_encoder(vocabulary(), {})
    words = [b"the", b"", "\u00e9t\u00e9".encode(), b"x" * 3000, b"<|endoftext|>", "a\u00a0".encode(), "\u00a0b".encode(), "\u3000".encode(), b"12,5%", b""]

    def alone(w):
        return encode(" " + w.decode()).tolist() if w else [lmscore.END]

    for some in (words, words[:5], [], [b""], [b"", b"a"]):
        ids, sizes = subwords.each(some)
        for w, got in zip(some, np.split(ids, np.cumsum(sizes)[:-1]) if some else [], strict=True):
            assert got.tolist() == alone(w)
    lexicon = lmscore.Lexicon(vocabulary())
    for some in ([b"of", b"zebra", b""], [b"zebra", b"zebra", b"quagga", b"", b"of"], words):
        at, _ = lexicon.numbers(some)
        ids, ends = lexicon.spelled(at)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [alone(w) for w in some]


def test_words_of_texts():
    """Distinct words and places give what splitting each text gives, with an empty word at its end."""
    texts = [b"  a  B a\n", b"", b" ", "\u00c9 x\u00a0y\x0b\x0cz\r\tQ".encode(), b"x\x00y \x1c z", b"b"]
    for some in (texts, texts[1:2], texts[5:], [b"skipped", *texts]):
        words, at, n = lmscore.texts_of(pa.array(some, pa.binary()).slice(some[0] == b"skipped"))
        want = [[*t.lower().split(), b""] for t in some if t != b"skipped"]
        assert [words[k] for k in at] == sum(want, []) and n.tolist() == list(map(len, want)) and len(set(words)) == len(words)


FAULTS = """
import resource
import numpy as np, pyarrow as pa
from voxloom.llm import lmscore as m
classes = m.Classes(np.arange(m.IDS) % m.ROWS, np.zeros(m.IDS), np.zeros(m.GROUPS), np.zeros((m.GROUPS, m.LEAVES)))
rng = np.random.default_rng(5)
pieces = [p for _ in range(300) for p in m.pieces_of(rng.integers(0, m.IDS, rng.integers(100, 4000)).astype(np.uint16))]
batch = pa.RecordBatch.from_pydict({"skip": [k for k, _ in pieces], "ids": [s.tobytes() for _, s in pieces]})
run, before = m._train("", classes, m.first_parameters(classes), 0.02), resource.getrusage(resource.RUSAGE_SELF).ru_minflt
(found,) = run(iter([batch]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / found.column("seen")[0].as_py())
"""


def test_training_maps_its_memory_once():
    """In a process of its own, as a worker has: steps reuse their arrays' memory instead of touching new pages for every one."""
    said = subprocess.run([sys.executable, "-c", FAULTS], capture_output=True, text=True, timeout=120, check=True, cwd=Path(lmscore.__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert float(said.stdout) < 0.1


def test_pieces_teach_each_id_once(classes):
    for n in (1, 5, lmscore.PIECE - 1, lmscore.PIECE, lmscore.PIECE + 1, 3 * lmscore.PIECE + 40):
        ids = np.random.default_rng(n).integers(0, lmscore.IDS, n).astype(np.uint16)
        parts = list(lmscore.pieces_of(ids))
        b = lmscore.blocks_of(np.concatenate([s for _, s in parts]), np.array([len(s) for _, s in parts]), np.array([k for k, _ in parts]), classes)
        assert b.target[b.mask].tolist() == ids.tolist()
        whole = lmscore.blocks_of(np.concatenate([[lmscore.END] * 3, ids]).astype(np.uint16), np.array([n + 3]), np.array([0]), classes)
        assert (b.rows[:, b.mask] == whole.rows[:, whole.mask]).all()


def test_every_piece_is_dealt_once(spark, monkeypatch):
    """Rounds and hands part the pieces, those of one identifier and one text too."""
    pieces = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("id"), F.col("id").alias("row"), F.lit(0).alias("piece"), F.lit(0).alias("skip"), F.lit(10).alias("size"), F.col("id").cast("string").cast("binary").alias("ids"))
    monkeypatch.setattr(lmscore, "HAND", 5000)
    found, hands = [], []
    for part in lmscore.deal(pieces, 2):
        rows = part.withColumn("task", F.spark_partition_id()).collect()
        found += [int(bytes(r.ids)) for r in rows]
        hands += Counter(r.task for r in rows).values()
    assert sorted(found) == list(range(4000)) and len(hands) == 8 and max(hands) < 2 * min(hands)


def test_training_helps_on_held_out_documents(spark):
    import random

    rng = random.Random(1)
    order = "ba bo bi be bu".split()

    def text(n):  # each word tells the next
        at, out = rng.randrange(5), []
        for _ in range(n):
            out.append(order[at])
            at = (at + (1 if rng.random() < 0.95 else rng.randrange(5))) % 5
        return " ".join(out)

    df = spark.createDataFrame([(k, text(60)) for k in range(3000)], "doc_id long, text string").coalesce(1)
    got = lmscore.language_scores(df, F.col("doc_id") % 7 == 2, vocabulary()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.75  # both are negative: the context is used


def test_empty_and_no_training_documents(spark):
    assert lmscore.language_scores(cases.empty(spark), F.lit(False), vocabulary()).count() == 0
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    got = lmscore.language_scores(df, F.lit(True), vocabulary()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in got) == [("1", 1, 0, 0), ("1", 1, 0, 0), ("None", 3, 0, 0)]

import random

from tests.llm import cases
from voxloom.llm import quality


def brute(text):
    text = text or ""
    w = cases.words(text)
    lines = [x for x in text.split("\n") if cases.words(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {p for found in at.values() if len(found) > 1 for i in found for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_measures(spark):
    rng = random.Random(2)
    texts = [r[1] for r in cases.rows()] + [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 40, 300)] + ["## a | b " * 9]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = cases.by_id(quality.ledger(df))
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), k


def test_bits_policies_and_ablations(spark):
    df = cases.frame(spark)
    found = quality.ledger(df)
    ledger = found.collect()
    assert {r.failed for r in ledger if r.doc_id in (12, 13)} == {1}
    table = {(r.version, r.rule): (r.fails, r.rejects_alone) for r in quality.ablations(found, [quality.BASE, quality.STRICT]).collect()}
    for policy in (quality.BASE, quality.STRICT):
        for b, (name, _) in enumerate(quality.RULES):
            if name in policy.rules:
                assert table[policy.version, name] == (sum(r.failed >> b & 1 for r in ledger), sum(r.failed & policy.mask == 1 << b for r in ledger))
    kept = quality.apply_policy(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in ledger if r.failed == 0}


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(4)
    clean = [cases.prose(rng, n) for n in (30, 100, 500)]
    junk = [" ".join(w + "%%%" for w in clean[1].split()), clean[1].upper().replace(" ", "!! "), " | ".join(clean[2].split()[:60]), "same " * 100, "\n".join(["a line that comes again"] * 30), " ".join(w for w in clean[1].split() for _ in range(7))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(clean + junk)], "doc_id long, text string")
    assert {r.doc_id for r in quality.apply_policy(df).collect()} == {0, 1, 2}


def test_empty(spark):
    assert quality.ledger(cases.empty(spark)).count() == 0
    assert quality.apply_policy(cases.empty(spark)).count() == 0
    assert quality.ablations(quality.ledger(cases.empty(spark)), [quality.BASE]).count() == 2

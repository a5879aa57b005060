from tests.llm import cases
from voxloom.llm.mixing import mix_rows, mix_sources


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(found, got):
    sizes = {}
    for r in found:
        sizes[r[3]] = sizes.get(r[3], 0) + len(cases.words(r[1]))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(found)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        largest = max(len(cases.words(r[1])) for r in found if r[3] == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1


def test_targets_and_budgets(spark):
    check(cases.rows(), mix_sources(cases.frame(spark)).collect())


def test_hot_source_and_ties(spark):
    found = [(k, "w " * (1 + k % 7), None, "hot" if k % 3 else f"s{k % 10}", 0, "", 0, "", 0.0, "", "", "") for k in range(900)]
    df = cases.frame(spark, found)
    got = mix_sources(df.repartition(7)).collect()
    check(found, got)
    assert sorted(got) == sorted(mix_sources(df.repartition(2)).collect())
    repeated = [(5, "w w", None, "s", 0, "", 0, "", 0.0, "", "", "")] * 20
    assert {r.taken for r in mix_sources(cases.frame(spark, repeated)).collect()} <= {0, 2, 4}


def test_empty_and_rows(spark):
    assert mix_sources(cases.empty(spark)).count() == 0
    assert mix_sources(cases.frame(spark, [r for r in cases.rows() if not (r[1] or "").strip()])).agg({"taken": "sum"}).first()[0] == 0
    df = cases.frame(spark)
    times = {r.doc_id: r.times for r in mix_sources(df).collect()}
    got = mix_rows(df)
    assert got.columns == df.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}


def test_rows_with_repeated_and_null_identifiers(spark):
    """Identifiers repeated within a source and over sources, and null ones: rows out are the sum of the times."""
    def row(i, text, source):
        return (i, text, None, source, 0, "", 0, "", 0.0, "", "", "")

    found = [row(1, "w " * 9, "a"), row(1, "w " * 9, "b"), row(2, "v " * 5, "a"), row(2, "u " * 7, "b"), row(2, "u " * 7, "b"), row(None, "n " * 4, "a"), row(None, "n " * 4, None), row(None, "m " * 8, "b")]
    found += [row(k, "w " * (k % 5), ["a", "b", "c", None][k % 4]) for k in range(3, 60)]
    df = cases.frame(spark, found)
    plan = mix_sources(df).collect()
    check(found, plan)
    got = mix_rows(df).collect()
    assert len(got) == sum(r.times for r in plan)
    want = {}
    for r in plan:
        want[r.doc_id, r.source, r.size] = want.get((r.doc_id, r.source, r.size), 0) + r.times
    have = {}
    for r in got:
        key = (r.doc_id, r.source, len(cases.words(r.text)))
        have[key] = have.get(key, 0) + 1
    assert have == {k: n for k, n in want.items() if n}
    assert mix_rows(cases.empty(spark)).count() == 0

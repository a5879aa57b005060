import hashlib

from pyspark.sql import functions as F

from tests.llm import cases
from voxloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(found, keep):
    groups = {}
    for r in found:
        groups.setdefault(r[1] or "", []).append(r[0])
    best = {t: (min if keep == "smallest" else max)(ids) for t, ids in groups.items()}
    return {(r[0], best[r[1] or ""], len(groups[r[1] or ""]), r[0] == best[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in found}


def test_against_brute_force(spark):
    for keep in ("smallest", "largest"):
        got = exact_duplicates(cases.frame(spark), keep=keep)
        assert {tuple(r) for r in got.collect()} == brute(cases.rows(), keep)


def test_a_group_over_many_tasks(spark):
    found = [(k, "copy" if k % 3 else f"text {k}", None, None, 0, "", 0, "", 0.0, "", "", "") for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keep in ("smallest", "largest"):
            got = exact_duplicates(cases.frame(spark, found).repartition(9), keep=keep)
            assert {tuple(r) for r in got.collect()} == brute(found, keep)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_and_null_identifiers(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = exact_duplicates(df).collect()
    assert sum(r.kept for r in got) == 3 and {r.group_size for r in got if r.doc_id == 1} == {3}
    assert exact_duplicates(df, keep="largest").where("kept").select("doc_id").orderBy("doc_id").collect()[0][0] is None
    assert drop_exact_duplicates(df, keep="largest").count() == 3


def test_normaliser_empty_table_and_columns(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B")], "doc_id long, text string")
    got = exact_duplicates(df, normalise=lambda c: F.lower(F.regexp_replace(c, r"\s+", " ")))
    assert [r.group_size for r in got.collect()] == [2, 2]
    assert exact_duplicates(cases.empty(spark)).count() == 0
    kept = drop_exact_duplicates(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, b, *_ in brute(cases.rows(), "smallest") if i == b}

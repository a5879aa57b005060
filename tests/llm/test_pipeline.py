import os
import random

import corpus_pipeline
from tests.llm import cases, test_exact_dedup, test_mixing, test_neardup
from voxloom.llm.mixing import mix_sources
from voxloom.llm.packing import ranks_encoder, vocabulary
from voxloom.llm.quality import STRICT, _measures, RULES


def rejected(text):
    from voxloom.llm.quality import MEASURES

    scope = dict(zip(MEASURES, _measures(text), strict=True))
    return any(eval(rule.replace(" AND ", " and "), {}, scope) for name, rule in RULES if name in STRICT.rules)  # noqa: S307


def test_against_brute_force(spark, tmp_path):
    found = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in test_neardup.corpus()]
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/sf/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()

    docs = [r for r in found if not rejected(r[1])]
    keep = {i for i, best, *_ in test_exact_dedup.brute(docs, "smallest") if i == best}
    docs = [r for r in docs if r[0] in keep]
    near = {i for i, _, _, k in test_neardup.brute([r[:2] for r in docs], 5) if k}
    docs = [r for r in docs if r[0] in near]
    rest = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mix_sources(rest).collect()
    test_mixing.check(docs, mixed)
    times = {r.doc_id: r.times for r in mixed if r.times}
    encode = ranks_encoder(vocabulary())
    want = {i: times[i] * (len(encode(t)) + 1) for i, t, *_ in docs if i in times}
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want and {r.doc_id for r in got} <= {r[0] for r in found}


def test_stages_give_documents(spark, tmp_path):
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_null_and_repeated_identifiers_and_empty_table(spark, tmp_path):
    """Distinct texts under null identifiers and identifiers repeated over sources: each row is mixed and packed by itself."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [cases.prose(random.Random(k), 60) for k in range(24)]
    ids = [None, None, 1, 1, 2, 2, *range(3, 21)]
    found = [(i, t, "en", [None, "a", "b"][k % 3], len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    for name, rows in (("some", found), ("none", [])):
        os.makedirs(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    encode = ranks_encoder(vocabulary())
    kept = [r for r in found if not rejected(r[1])]
    times = mix_sources(spark.createDataFrame(kept, schema)).agg({"times": "sum"}).first()[0]
    assert len(got) == times  # all texts are shorter than a sequence
    assert {r.length for r in got} <= {len(encode(r[1])) + 1 for r in kept}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

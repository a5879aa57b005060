"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from voxloom.llm import exact_dedup, hardneg, lexical, lmscore, mixing, neardup, packing, pii, quality, secrets, sharding, urlfilter, warc

QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_sharding": sharding.op6_sharding,
    "op7_lm_scoring": lmscore.op7_lm_scoring,
    "op8_pii": pii.op8_pii,
    "op9_secrets": secrets.op9_secrets,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_url_filter": urlfilter.op13_url_filter,
}
SQL = neardup.SQL | mixing.SQL | warc.SQL | quality.SQL | exact_dedup.SQL | lexical.SQL | hardneg.SQL | urlfilter.SQL

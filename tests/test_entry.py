import re

import __spark_entry__


def test_queries_and_oracles():
    found, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(found) and len(found) > 110
    assert all(callable(f) for f in found.values())


def test_every_operator_has_a_query():
    ids = {re.match(r"[A-Z]\d+", n)[0] for n in __spark_entry__.queries() if re.match(r"[A-Z]\d+", n)}
    for letter, last, absent in (("A", 15, ()), ("B", 16, ()), ("C", 11, ()), ("D", 43, ()), ("E", 13, ()), ("F", 7, ()), ("G", 4, ()), ("H", 18, ()), ("I", 5, ()), ("K", 6, ()), ("J", 4, ())):
        for k in range(1, last + 1):
            assert k in absent or f"{letter}{k:02d}" in ids, f"{letter}{k}"


def test_flagship(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5

import datetime
import re

from pyspark.sql import functions as F

from tests.llm import cases
from voxloom.llm import pii


def made(spark, texts, **options):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return cases.by_id(pii.pseudonyms(df, "key", **options))


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_formats_hold_and_values_stay_linked(spark):
    texts = ["+1 (743) 555-3824", "743-555-3824", "4785380592391139", "4785 3805 9239 1139", "2024-02-29", "29.02.2024", "10.1.2.3", "a.b7@x.org", "123-45-6789"]
    got = made(spark, [f"see {t}, or {t}." for t in texts])
    out = []
    for k, t in enumerate(texts):
        assert got[k].n_found == 2
        a, b = re.fullmatch(r"see (.*), or (.*)\.", got[k].text).groups()
        assert a == b != t
        out.append(a)
    digits = lambda s: re.sub(r"\D", "", s)[-16:]
    assert digits(out[0])[-10:] == digits(out[1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0])
    assert digits(out[2]) == digits(out[3]) and luhn(out[2]) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", out[3])
    assert datetime.date.fromisoformat(out[4]) == datetime.datetime.strptime(out[5], "%d.%m.%Y").date()
    assert all(0 <= int(x) <= 255 for x in out[6].split("."))
    assert re.fullmatch(r"[a-z]\.[a-z]\d@x\.org", out[7]) and re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[8])


def test_invalid_values_and_clean_texts_stay(spark):
    texts = ["4785380592391138", "999.1.2.3 01.2.3.4 1.2.3", "2023-02-29 2024-13-01", "000-12-3456 666-12-3456", "version 4.0. of 12 things", "plain words", "", None, "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "1" * 5000]
    got = made(spark, texts + [r[1] for r in cases.rows()])
    assert all(got[k].text == t and got[k].n_found == 0 and got[k].spans == "" for k, t in enumerate(texts))
    assert all(got[len(texts) + k].text == r[1] for k, r in enumerate(cases.rows()))


def test_permutation_is_one_to_one(spark):
    grid = spark.range(5 * 7 * 3).select(F.array((F.col("id") % 5).cast("int"), (F.floor(F.col("id") / 5) % 7).cast("int"), F.floor(F.col("id") / 35).cast("int")).alias("x"))
    out = grid.select(pii.permute(F.col("x"), F.array(F.lit(5), F.lit(7), F.lit(3)), "k", "test").alias("y"))
    assert out.distinct().count() == 105 and out.where("y[0] >= 5 OR y[1] >= 7 OR y[2] >= 3").count() == 0
    days = spark.range(0, 146_097, 97).select(F.date_format(F.date_add(F.to_date(F.lit("1800-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"), F.col("id").alias("doc_id"))
    assert pii.pseudonyms(days, "k").where("n_date = 1").select("text").distinct().count() == days.count()


def test_spans_and_rebuilding(spark):
    text = "é 10.0.0.1 x jo@ex.org, 123-45-6789! 10.0.0.1"
    row = made(spark, [text])[0]
    found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row.spans.split(","))]
    assert found == [("ipv4", "10.0.0.1"), ("email", "jo@ex.org"), ("ssn", "123-45-6789"), ("ipv4", "10.0.0.1")]
    assert re.fullmatch(r"é (\S+) x \w\w@ex\.org, \d{3}-\d{2}-\d{4}! \1", row.text)
    assert made(spark, [text], kinds=("ssn",))[0].n_found == 1


def test_cards_next_to_other_numbers(spark):
    card, other = "4111 1111 1111 1111", "4845168114407329"
    texts = [card, f"{card} {other}", "7536784127813050 4845168114407329", f"{card} 2024", f"{card} 12/25", f"{card} 07", f"17 {card}", f"{card} 2nd", f"{card} 10.0.0.1", f"{card} 743-555-3824", f"x {card} 2024-01-05 {card}", f"{card} a1@x.org", "3782 822463 10005 123", "1234 " * 40]
    got = made(spark, texts)
    new = got[0].text
    assert luhn(new) and new != card
    for k in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert new in got[k].text and card not in got[k].text, got[k]
    assert [got[k].n_card for k in range(13)] == [1, 2, 2] + [1] * 7 + [2, 1, 1]
    assert other not in got[1].text and got[2].text[17:] == got[1].text[20:] and luhn(got[2].text[:16])
    assert got[8].n_ipv4 == got[9].n_phone == got[10].n_date == got[11].n_email == 1
    assert got[1].spans == "card:0:19,card:20:36" and got[6].spans == "card:3:22"
    assert got[12].text.endswith(" 123") and got[12].text[:17] != texts[12][:17]


def test_letters_of_other_alphabets(spark):
    got = made(spark, ["an iñe.19@mail5.example.com, é@x.org", "x" * 70 + "@ex.org"])
    assert re.match(r"an [a-z]ñ[a-z]\.\d\d@mail5\.example\.com, é@x\.org", got[0].text) and "iñe.19@" not in got[0].text and got[0].n_email == 2
    assert got[1].n_email == 0  # a local part has 64 characters at most


def test_empty_and_columns(spark):
    assert pii.pseudonyms(cases.empty(spark), "k").count() == 0
    assert pii.pseudonyms(cases.frame(spark), "k").count() == len(cases.rows())

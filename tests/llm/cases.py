"""Awkward rows that every operator over documents must take, and helpers to look at results."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, part int, size string, row double, component string, sha string, key string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice("bcdfgmnprst") + rng.choice("aeiou") + str(rng.randrange(vocabulary) % 7) + rng.choice("lnrst") + chr(97 + rng.randrange(26)) for _ in range(n))


def rows(seed=1):
    """Exact and near copies, nulls in every column, empty and very long texts, ties, and columns with clashing names."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (40, 60, 200, 25, 8, 2, 1)]
    texts = [*base, base[0], base[0], base[1].upper(), base[2] + " extra words at the end", base[2][:-9], "", None, "", None, "   \n\t ", "one", "ÉÉ é É", "a b c d e", prose(rng, 30_000), "x" * 50_000, "same " * 300, "line one two\nline one two\nline\n\nline one two"]
    out = [(k, t, None if k % 5 == 0 else "en", [None, "b", "a", "b", "b"][k % 5], len(t or ""), "x", 1, None, 0.5, "c", None, "k") for k, t in enumerate(texts)]
    return out


def frame(spark, found=None):
    return spark.createDataFrame(rows() if found is None else found, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, id_col="doc_id"):
    return {r[id_col]: r for r in df.collect()}

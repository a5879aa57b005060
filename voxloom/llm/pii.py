"""Format-preserving Feistel pseudonyms for personal data, with column functions only.

Numbers, dates and addresses of a known form are validated and then permuted within their form by a keyed Feistel
network: a card number stays a valid card number, a date a date, and equal values become equal values in every document,
whatever their punctuation. A value is a list of symbols, each with a radix; round r adds to symbol r mod n a keyed
digest of all the others, so that every round, and hence the whole, is a permutation of the form's values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.llm.common import read

KINDS = ("email", "ipv4", "ssn", "phone", "date", "card")
_L, _R = r"(?<![\p{L}\p{N}_.+-])", r"(?![\p{L}\p{N}_])"
#: A number of a card's, and what may stand after it without being one.
_GROUP = r"[0-9]++(?![\p{L}\p{N}_]|-[0-9]++[\p{L}\p{N}_])"
_OTHER = r"(?!(?:[0-9]{1,2}[./]){2}[0-9]{4}|(?:[0-9]{1,3}\.){3}[0-9]|[\p{L}\p{N}._%+-]{1,64}+@)"
#: Fixed forms, in the order in which they are tried. Numbers one space or hyphen apart are one match, in which cards are looked for.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _R,
    "ipv4": _L + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}_]|\.[0-9])",
    "ssn": _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])",
    "phone": r"(?<![\p{L}\p{N}_.+-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}_-])",
    "date": _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}_-])",
    "card": _L + r"(?=[0-9](?:[ -]?[0-9]){12})" + _GROUP + rf"(?:[ -]{_OTHER}{_GROUP})*+",
}
#: Days from 1800-01-01 to 2199-12-31, and their number as a product.
_DAY_ZERO, _DAYS = "1800-01-01", (189, 773)
PASSES = 4
#: Digits of a card's numbers where they are grouped as usual; other groupings come after these.
_USUAL = ("4-4-4-4", "4-6-5", "4-4-4-4-3")


def _luhn_sum(digits: Column, parity: int) -> Column:
    """Sum of an array of digits, those at an odd distance from the end (or even, by ``parity``) doubled."""
    n = F.size(digits)
    parts = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == parity, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d)


def _ints(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permute(symbols: Column, radices: Column, key: str, kind: Column | str) -> Column:
    """``symbols`` (array<int>, each below its radix) under the keyed permutation of its form."""
    label = F.lit(kind) if isinstance(kind, str) else kind

    def whole(form: Column) -> Column:
        n = F.size(form["radices"])

        def one(state: Column, r: Column) -> Column:
            others = F.array_join(F.transform(state, lambda x, i: F.when(i == r % n, F.lit("_")).otherwise(x.cast("string"))), ".")
            digest = F.sha2(F.concat_ws("/", form["head"], r.cast("string"), others), 256)
            step = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
            return F.transform(state, lambda x, i: F.when(i == r % n, ((x + step) % F.get(form["radices"], i)).cast("int")).otherwise(x))

        return F.aggregate(F.sequence(F.lit(0), n * PASSES - 1), form["symbols"], one)

    head = F.concat_ws("/", F.lit(key), label, F.array_join(radices.cast("array<string>"), "."))
    return bound(F.struct(symbols.cast("array<int>").alias("symbols"), radices.cast("array<int>").alias("radices"), head.alias("head")), whole)


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its decimal digits replaced, in order, by those of the string ``digits``."""
    upto = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, upto(i), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))), ""
    )


def _email(m: Column, key: str) -> Column:
    """The local part: letters from A to Z stay letters of their case, digits stay digits; other characters and the domain are kept."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    chars = F.filter(F.split(local, ""), lambda c: c != "")
    low = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97).otherwise(F.ascii(c))
    parts = F.transform(chars, lambda c: F.struct(c.alias("c"), (F.ascii(c) - low(c)).alias("x"), low(c).alias("low"), F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).alias("radix")))

    def made(p: Column) -> Column:
        out = permute(F.transform(p, lambda c: c["x"]), F.transform(p, lambda c: c["radix"]), key, F.concat(F.lit("email@"), F.lower(domain)))
        return F.concat(F.array_join(F.zip_with(p, out, lambda c, x: F.when(c["radix"] == 1, c["c"]).otherwise(F.char(c["low"] + x))), ""), F.lit("@"), domain)

    return bound(parts, made)


def _ipv4(m: Column, key: str) -> Column:
    valid = F.forall(F.split(m, r"\."), lambda c: (c.cast("int") <= 255) & ~c.rlike("^0[0-9]"))
    octets = F.transform(F.split(m, r"\."), lambda c: c.cast("int"))
    return F.when(valid, F.array_join(permute(octets, F.array_repeat(F.lit(256), 4), key, "ipv4").cast("array<string>"), "."))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    a, g, s = (F.split_part(m, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    valid = a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)

    def made(out: Column) -> Column:
        area, group, serial = (F.get(out, F.lit(k)) + 1 for k in range(3))
        area = F.when(area >= 666, area + 1).otherwise(area)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))

    moved = permute(F.array(F.when(a > 666, a - 2).otherwise(a - 1), g - 1, s - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    return F.when(valid, bound(moved, made))


def _phone(m: Column, key: str) -> Column:
    """Ten digits; a country code is kept. First digits of area and exchange stay on their side of 2."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(F.length(digits) > 10, F.lit("1")).otherwise("")
    leads = lambda i: (i == 0) | (i == 3)
    low = lambda d, i: F.when(leads(i) & (d > 1), 2).otherwise(0)
    parts = F.transform(_ints(F.right(digits, F.lit(10))), lambda d, i: F.struct((d - low(d, i)).alias("x"), low(d, i).alias("low"), F.when(leads(i), F.when(d > 1, 8).otherwise(2)).otherwise(10).alias("radix")))

    def made(p: Column) -> Column:
        out = permute(F.transform(p, lambda c: c["x"]), F.transform(p, lambda c: c["radix"]), key, "phone")
        return F.concat(code, F.array_join(F.zip_with(out, p, lambda x, c: (x + c["low"]).cast("string")), ""))

    return bound(bound(parts, made), lambda ten: _fill(m, ten))


def _date(m: Column, key: str) -> Column:
    """A calendar day of 1800 to 2199. Of nn/nn/nnnn, month first is tried, and then day first."""
    forms = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"/", "MM/dd/yyyy"), (r"/", "dd/MM/yyyy"), (r"\.", "dd.MM.yyyy"))
    day = lambda form: F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.to_date(F.lit(_DAY_ZERO)))
    tried = [F.when(m.rlike(shape), F.struct(day(form).alias("day"), F.lit(k).alias("form"))) for k, (shape, form) in enumerate(forms)]
    first = F.get(F.filter(F.array(*tried), lambda x: x["day"].between(0, _DAYS[0] * _DAYS[1] - 1)), F.lit(0))

    def made(x: Column) -> Column:
        moved = permute(F.array(F.floor(x["day"] / _DAYS[1]).cast("int"), (x["day"] % _DAYS[1]).cast("int")), F.array(*map(F.lit, _DAYS)), key, "date")
        new = bound(moved, lambda out: F.date_add(F.to_date(F.lit(_DAY_ZERO)), F.get(out, F.lit(0)) * _DAYS[1] + F.get(out, F.lit(1))))
        return bound(new, lambda d: F.get(F.array(*[F.date_format(d, form) for _, form in forms]), x["form"]))

    return bound(first, lambda x: F.when(x.isNotNull(), made(x)))


def _card(m: Column, key: str) -> Column:
    """13 to 19 digits whose check digit holds; the others are permuted and the check digit is made anew."""

    def made(digits: Column) -> Column:
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        moved = permute(body, F.array_repeat(F.lit(10), F.size(digits) - 1), key, "card")
        filled = bound(moved, lambda out: F.concat(F.array_join(out.cast("array<string>"), ""), ((10 - _luhn_sum(out, 0) % 10) % 10).cast("string")))
        return F.when(F.size(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0), bound(filled, lambda new: _fill(m, new)))

    return bound(_ints(F.regexp_replace(m, "[^0-9]", "")), made)


def _is_joint(m: Column) -> Column:
    return m.rlike("^[0-9][0-9 -]*[ -][0-9 -]*$") & (F.length(F.translate(m, " -", "")) >= 13)


def _marked(m: Column) -> Column:
    """Numbers one space or hyphen apart, with <> around every card: one number or a usual grouping first, then as many numbers as
    hold together elsewhere, from left to right."""

    def choose(x: Column) -> Column:
        n = F.size(x["g"])

        def fits(i: Column, k: Column) -> Column:
            digits = F.array_join(F.slice(x["g"], i + 1, k), "")
            return F.when(F.length(digits).between(13, 19), bound(_ints(digits), lambda d: _luhn_sum(d, 1) % 10 == 0)).otherwise(False)

        def longest(i: Column, use: Callable[[Column], Column]) -> Column:
            return F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: use(k) & fits(i, k)))

        def usual(i: Column) -> Column:
            shape = lambda k: F.array_join(F.transform(F.slice(x["g"], i + 1, k), lambda v: F.length(v).cast("string")), "-")
            return longest(i, lambda k: (k == 1) | shape(k).isin(*_USUAL))

        def mark(first: Column) -> Column:
            clear = lambda i, k: ~F.exists(F.slice(first, i + 1, k), lambda v: v.isNotNull())
            take = F.transform(first, lambda v, i: F.coalesce(v, longest(i, lambda k: clear(i, k))))

            def put(taken: Column) -> Column:
                def step(s: Column, i: Column) -> Column:
                    picked = F.when(i >= s["until"], F.get(taken, i))
                    until = F.coalesce(i + picked, s["until"])
                    sep = F.when(i > 0, F.get(x["seps"], i - 1)).otherwise("")
                    return F.struct(until.alias("until"), F.concat(s["out"], sep, F.when(picked.isNotNull(), "<").otherwise(""), F.get(x["g"], i), F.when(i + 1 == until, ">").otherwise("")).alias("out"))

                return F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("until"), F.lit("").alias("out")), step, lambda s: s["out"])

            return bound(take, put)

        return bound(F.transform(x["g"], lambda _, i: usual(i)), mark)

    seps = F.filter(F.split(F.regexp_replace(m, "[0-9]+", ""), ""), lambda c: c != "")
    return bound(F.struct(F.split(m, "[ -]").alias("g"), seps.alias("seps")), choose)


def _pieces(m: Column, pattern: str) -> Column:
    """``m`` as an array of what stays and what is found after it: cards of a joint run, and other kinds between them."""
    cut = bound(_marked(m), lambda s: F.zip_with(F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(a.alias("rest"), F.translate(b, "<>", "").alias("found"))))
    return F.when(_is_joint(m), cut).otherwise(F.array(F.struct(F.lit("").alias("rest"), m.alias("found"))))


_MAKERS = {"email": _email, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "date": _date, "card": _card}


def pseudonyms(docs: DataFrame, key: str, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, text, n_<kind> ..., n_found, spans``.

    text: the whole text with every valid value of the kinds replaced by its pseudonym; invalid ones (a wrong check digit, no
    such day, an octet above 255) and all else stay as they are; so does an address with a local part of over 64 characters or
    over nine labels in its domain, which is no valid one. spans: ``kind:start:end`` in code points of the given text,
    end exclusive. A null text stays null with no spans; repeated rows become equal rows; null identifiers
    stay null. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    kinds = tuple(k for k in KINDS if k in kinds)
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def judge(m: Column) -> Column:
        """The kind is that of the first pattern that holds for the whole match; new is null for an invalid value."""
        made = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new"))
        for k in reversed(kinds):
            made = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.struct(F.lit(k).alias("kind"), _MAKERS[k](m, key).alias("new"))).otherwise(made)
        return made

    # explode(array(x)) keeps x from being evaluated once for each later use
    rows = rows.select("id", "text", F.explode(F.array(F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))).alias("found"))
    some = F.size("found") > 0
    rows = rows.select("id", "text", "found", F.explode(F.array(F.when(some, F.split("text", pattern, -1)))).alias("rest"))
    if "card" in kinds:
        inner = "|".join(["<[0-9 -]+>", *[f"(?:{PATTERNS[k]})" for k in kinds if k in ("ssn", "phone", "date")]])
        split = F.zip_with("rest", "found", lambda a, m: F.when(m.isNull(), F.array(F.struct(a.alias("rest"), m.alias("found")))).otherwise(F.transform(_pieces(m, inner), lambda p, i: F.struct(F.when(i == 0, F.concat(a, p["rest"])).otherwise(p["rest"]).alias("rest"), p["found"].alias("found")))))
        whole = F.zip_with("rest", "found", lambda a, m: F.struct(a.alias("rest"), m.alias("found")))
        rows = rows.select("id", "text", F.explode(F.array(F.when(F.exists("found", _is_joint), F.flatten(split)).otherwise(whole))).alias("x")).select("id", "text", F.col("x.rest").alias("rest"), F.col("x.found").alias("found"))
    rows = rows.select("id", "text", "found", F.explode(F.array(F.struct(F.col("rest"), F.when(some, F.transform("found", judge)).alias("made")))).alias("x")).select("id", "text", "found", "x.*")
    lengths = F.zip_with("rest", "found", lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda s, n: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + n))
    rows = rows.select("id", "text", "found", "rest", "made", F.explode(F.array(ends)).alias("ends"))

    put = F.zip_with("rest", F.zip_with("found", "made", lambda m, x: F.coalesce(x["new"], m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    span = F.transform("made", lambda x, i: F.when(x["new"].isNotNull(), F.concat_ws(":", x["kind"], (F.get("ends", i) - F.length(F.get("found", i))).cast("string"), F.get("ends", i).cast("string"))))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("made", lambda x: (x["kind"] == kind) & x["new"].isNotNull())), F.lit(0)).cast("long").alias(f"n_{kind}")

    out = rows.select("id", F.when(some, F.array_join(put, "")).otherwise(F.col("text")).alias("text"), *map(count, kinds), F.when(some, F.array_join(span, ",")).otherwise("").alias("spans"))
    total = reduce(Column.__add__, [F.col(f"n_{k}") for k in kinds])
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *[f"n_{k}" for k in kinds], total.alias("n_found"), "spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(read(spark, sf_dir, "documents"), key="corpus-pseudonyms-1")

"""Personal data: validated values become keyed pseudonyms of the same format. DataFrame functions only.

Numbers and dates are permuted by a Feistel network over their own domain, keyed by SHA-256, so a value stays linked to
itself across documents and the text keeps its shape:

* payment cards (13 to 19 digits in groups of any size with single separators, Luhn-valid): first digit kept, the rest permuted, check digit recomputed;
* US social security numbers (valid area, group, serial): permuted within the valid ones;
* phone numbers with an area code of three digits, and those of 8 to 15 digits that begin with + and a country code: all
  digits after the country code permuted, separators kept;
* IPv4 addresses (octets up to 255): the 32 bits permuted;
* dates (yyyy-mm-dd, dd/mm/yyyy, else mm/dd/yyyy, dd.mm.yyyy; real days from 1800 to 2199): permuted within these 146,000 days.

E-mail addresses and secrets (access keys; password= and token= values of eight or more characters, names in any case,
values up to the next space or quote) have no numeric domain; they become keyed hashes of a like form, of 64 characters
at most. A value that fails its validation is left as it is.

A document is cut at the matches of one expression; pieces and pseudonyms are joined again. No shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import fresh, spread

KINDS = ("secret", "email", "ip", "date", "ssn", "phone", "card")
ROUNDS, KEY_CONF, BASE_DAY = 8, "spark.pathloom.pii.key", "1800-01-01"
#: Before the value of a secret, in any case.
_NAME = r"(?i:password|passwd|secret|api_key|apikey|token)\s{0,3}[=:]\s{0,3}"
#: A phone number without a country code, and what is no further group of a number when it follows a separator.
_LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_APART = r"(?:[A-Za-z0-9._%+-]{1,64}+@|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[0-9]{13,19}(?![0-9])|[0-9]{4}[ -](?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{6}[ -][0-9]{4,5})(?![0-9]))"
#: A country code: 1, 7, or one of the two-digit codes, else three digits.
_COUNTRY = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})[ .-]?)?"
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|" + _NAME + r"(?:\"[^\s\"]{8,}+\"?|'[^\s']{8,}+'?|[^\s\"'][^\s\"]{7,}+\"?))",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|\+[1-9](?:(?:[ -](?!" + _APART + r")|\.)?\(?[0-9]\)?){7,14}|" + _LOCAL + ")(?![0-9])",
    "card": r"(?<![0-9.-])(?:[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3}(?![0-9]))?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19}|[0-9](?:[ -](?!" + _APART + "|" + _LOCAL + r"(?![0-9]))[0-9]|[0-9]){12,30})(?![0-9]|[.-][0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: Texts without any of these have no match.
HINT = "[0-9@=:]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: what a lambda captures is computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prf(key: Column, *parts) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", key, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, tweak) -> Column:
    """A keyed permutation of pairs (a, b) below (size_a, size_b): rounds add a hash of one half to the other."""

    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        x = F.when(odd, F.pmod(s["a"] + F.pmod(_prf(key, tweak, r, s["b"]), size_a), size_a)).otherwise(s["a"])
        y = F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_prf(key, tweak, r, s["a"]), size_b), size_b))
        return F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def permute_digits(digits: Column, key: Column, tweak) -> Column:
    """Another string of as many digits (2 to 18)."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    pair = F.struct(F.substring(digits, F.lit(1), left).cast("long").alias("a"), F.substring(digits, left + 1, right).cast("long").alias("b"), ten(left).alias("x"), ten(right).alias("y"))
    moved = let(pair, lambda p: _feistel(p["a"], p["b"], p["x"], p["y"], key, tweak))
    return let(moved, lambda out: F.concat(F.lpad(out["a"].cast("string"), left, F.lit("0")), F.lpad(out["b"].cast("string"), right, F.lit("0"))))


def _other_ssn(digits: Column, key: Column) -> Column:
    """Another valid number: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, rest = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 2).cast("long") * 9999 + F.substring(digits, 6, 4).cast("long") - 10_000
    moved = _feistel(area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1)), rest, F.lit(898), F.lit(99 * 9999), key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("int").cast("string"), n, "0")
    return let(moved, lambda x: F.concat(pad(x["a"] + F.when(x["a"] >= 665, F.lit(2)).otherwise(F.lit(1)), 3), pad(F.floor(x["b"] / 9999) + 1, 2), pad(x["b"] % 9999 + 1, 4)))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def luhn(digits: Column) -> Column:
    return let(digits, _luhn)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    return let(digits, lambda d: _put(shape, d))


def _put(shape: Column, digits: Column) -> Column:
    def put(s: Column, c: Column) -> Column:
        is_digit = F.regexp_like(c, F.lit("[0-9]"))
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card_end(m: Column) -> Column:
    """Where the card ends in a run of groups of digits, as other numbers may follow it: the longest Luhn-valid beginning of
    whole groups with 13 to 19 digits; null if there is none."""
    is_digit = lambda n: F.regexp_like(F.substring(m, n, F.lit(1)), F.lit("[0-9]"))
    to = lambda n: _digits(F.substring(m, F.lit(1), n))
    ends = F.filter(F.sequence(F.greatest(F.length(m), F.lit(13)), F.lit(13), F.lit(-1)), lambda n: is_digit(n) & ~is_digit(n + 1) & F.length(to(n)).between(13, 19))
    return F.get(F.filter(ends, lambda n: luhn(to(n)) == 0), F.lit(0))


def _other_card(digits: Column, key: Column) -> Column:
    """Another card number of as many digits."""
    stem = F.concat(F.substring(digits, 1, 1), permute_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    return let(stem, lambda s: F.concat(s, F.pmod(10 - luhn(F.concat(s, F.lit("0"))), F.lit(10)).cast("string")))


def kind_of(m: Column) -> Column:
    """Which of ``KINDS`` a match is; null if its validation fails."""
    tests = {
        "email": F.contains(m, F.lit("@")),
        "secret": F.regexp_like(m, F.lit(f"^(?:AKIA[0-9A-Z]{{16}}$|{_NAME})")),
        "ip": F.regexp_like(m, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "date": F.regexp_like(m, F.lit(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$")),
        "ssn": F.regexp_like(m, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "phone": F.regexp_like(m, F.lit(r"^\+|^\(|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")),
        "card": F.lit(True),
    }
    valid = {
        "ip": F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255),
        "date": _day(m).between(0, 145_999),
        "ssn": ~F.regexp_like(m, F.lit("^(000|666|9)|-00-|-0000$")),
        "card": _card_end(m).isNotNull(),
    }
    out = F.lit(None).cast("string")
    for name in reversed(KINDS):
        out = F.when(tests[name], F.when(F.coalesce(valid.get(name, F.lit(True)), F.lit(False)), F.lit(name))).otherwise(out)
    return out


#: Of two that fit, the later one holds: 12/25/1999 is month first, as there is no day 12/25.
_FORMATS = (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy"))


def _by_format(m: Column, use) -> Column:
    """``use(day, format)`` with the format in which the match is a day; null where there is no such day."""
    out = F.lit(None)
    for sign, form in _FORMATS:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        out = F.when(F.contains(m, F.lit(sign)) & day.isNotNull(), use(day, form)).otherwise(out)
    return out


def _day(m: Column) -> Column:
    """Days since ``BASE_DAY``; null where there is no such day."""
    return F.datediff(_by_format(m, lambda day, _: day), F.lit(BASE_DAY).cast("date"))


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """What stands for the match."""
    digits = _digits(m)
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    ip = _feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), key, "ip")
    half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("int").cast("string"), (x % 256).cast("int").cast("string"))
    day = _day(m)
    moved = _feistel(F.floor(day / 400), day % 400, F.lit(365), F.lit(400), key, "date")
    new_day = let(moved, lambda x: F.date_add(F.lit(BASE_DAY).cast("date"), (x["a"] * 400 + x["b"]).cast("int")))
    date = let(new_day, lambda x: _by_format(m, lambda _, form: F.date_format(x, form)))
    code = F.regexp_extract(m, _COUNTRY, 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    card = let(_card_end(m), lambda n: F.concat(_refill(F.substring(m, F.lit(1), n), let(_digits(F.substring(m, F.lit(1), n)), lambda d: _other_card(d, key))), F.substring(m, n + 1, F.length(m))))
    name = F.regexp_extract(m, f"^({_NAME}[\"']?|AKIA)", 1)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    quote = F.regexp_extract(value, "[\"']?$", 0)
    hidden = F.sha2(F.concat_ws("|", key, F.lit("secret"), F.regexp_replace(value, "[\"']$", "")), 256)
    secret = F.when(name == "AKIA", F.concat(name, F.upper(F.substring(hidden, 1, 16)))).otherwise(F.concat(name, F.substring(hidden, F.lit(1), F.least(F.lit(64), F.length(value) - F.length(quote))), quote))
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 12), F.lit("@masked.example"))
    forms = {"email": email, "secret": secret, "ip": let(ip, lambda x: F.concat_ws(".", half(x["a"]), half(x["b"]))), "date": date, "ssn": _refill(m, let(digits, lambda x: _other_ssn(x, key))), "phone": F.concat(code, _refill(rest, let(_digits(rest), lambda x: permute_digits(x, key, "phone")))), "card": card}
    return reduce(lambda out, k: F.when(kind == k, forms[k]).otherwise(out), reversed(KINDS), m)


def key_of(docs: DataFrame, key: str | None = None) -> str:
    """The argument, else ``spark.pathloom.pii.key`` of the session; without a key pseudonyms could be undone by anyone, so none is an error."""
    found = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not found:
        raise ValueError(f"no key: give one or set {KEY_CONF}")
    return found


def _rewritten(docs: DataFrame, key: str | None, names: tuple[str, str]) -> DataFrame:
    """``docs`` with text rewritten in place and two more columns, the kinds found and their number, called ``names``."""
    secret = F.lit(key_of(docs, key))
    m, h, p, s = fresh([*docs.columns, *names], "_matches", "_kinds", "_pieces", "_swapped")
    matches = F.when(F.regexp_like("text", F.lit(HINT)), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    hits = F.transform(m, lambda x: F.struct(x.alias("m"), kind_of(x).alias("kind")))
    out = docs.withColumn(m, F.coalesce(matches, F.array().cast("array<string>"))).withColumn(h, hits)
    swapped = F.transform(h, lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(pseudonym(x["m"], x["kind"], secret)))
    rewritten = F.concat(F.get(p, F.lit(0)), F.array_join(F.zip_with(s, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), ""))
    out = out.withColumn(names[0], F.transform(F.filter(h, lambda x: x["kind"].isNotNull()), lambda x: x["kind"]))
    some = F.size(names[0]) > 0
    out = out.withColumn(p, F.when(some, F.split("text", PATTERN, -1))).withColumn(s, F.when(some, swapped))
    out = out.withColumn("text", F.when(some, rewritten).otherwise(F.col("text"))).withColumn(names[1], F.size(names[0]).cast("long"))
    return out.select(*[f"`{c}`" for c in docs.columns], *names)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All columns of ``docs``, ``text`` rewritten, and ``found``: the kinds found, in order (``n_found`` of them).

    For the key see ``key_of``. A null text stays null with nothing found; repeated rows are treated alike. Columns of
    ``docs`` named found or n_found are replaced; any other name is the user's and comes through as it is.
    """
    return _rewritten(docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("found", "n_found")]), key, ("found", "n_found"))


def rewrite(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The columns of ``docs``, all of them, with ``text`` rewritten."""
    return _rewritten(docs, key, tuple(fresh(docs.columns, "found", "n_found"))).select(*[f"`{c}`" for c in docs.columns])


def pseudonym_report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_found, found (kinds, comma-joined), text."""
    return pseudonymise(spread(docs.select("doc_id", "text")), key).select("doc_id", "n_found", F.array_join("found", ",").alias("found"), "text")

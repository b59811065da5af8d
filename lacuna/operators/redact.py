"""Redaction by mask, keyed hash or surrogate, and counts by type."""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.folding import casefold
from lacuna.functions.spans import near_each, piece

STRATEGIES = ("mask", "hash", "surrogate")

#: What a surrogate of a named kind is picked from.
_FIRST = ("Alex", "Robin", "Jordan", "Casey", "Avery", "Rowan", "Morgan", "Dana", "Quinn", "Harper", "Riley", "Emery", "Sage", "Tatum", "Blair", "Devon", "Ellis", "Frankie", "Jules", "Kendall", "Lane", "Marlow", "Noel", "Oakley", "Parker", "Reese", "Skyler", "Teagan", "Val", "Wren")
_LAST = ("Morgan", "Taylor", "Ellis", "Brooks", "Quinn", "Blake", "Reid", "Hollis", "Archer", "Barlow", "Carver", "Dalton", "Easton", "Farrow", "Garner", "Hadley", "Ingram", "Jarvis", "Keating", "Lowell", "Mercer", "Norwood", "Osborn", "Presley", "Ramsey", "Sawyer", "Thorne", "Upton", "Vance", "Winslow", "Yardley")
_ROADS = ("Example", "Sample", "Model", "Pattern", "Specimen", "Template", "Fictive", "Mockup", "Stand In", "Dummy", "Nominal")
_KINDS = ("Street", "Road", "Avenue", "Lane", "Drive", "Court", "Place", "Terrace", "Crescent")
_CARE = ("Health", "Clinic", "Hospital", "Medical Centre", "Health Centre")
SHAPED = ("MRN", "NHI", "MEDICARE", "IHI", "ID")

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FROM = _DIGITS + _UPPER + _UPPER.lower()
_TO = _DIGITS[7:] + _DIGITS[:7] + _UPPER[13:] + _UPPER[:13] + (_UPPER[13:] + _UPPER[:13]).lower()


def normalize(c: Column) -> Column:
    """Case folded in full, white space collapsed, none at the ends."""
    return F.trim(F.regexp_replace(casefold(c), r"(?U)\s+", " "))


def hmac_sha256(key: str, message: Column) -> Column:
    """Native HMAC, in hex.

    The padded key is a literal of the plan and so shows in explain() and in event logs. With real keys
    use ``keyed_udf``, which keeps it in a Python closure.
    """
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


#: White space, as the column functions have it.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def keyed_udf(key: str):
    """HMAC of the message of each (type, text), in Arrow batches; the key stays out of the plan."""
    def one(kind: str, text: str) -> str:
        message = f"{kind}:{_SPACES.sub(' ', text.casefold()).strip(' ')}"
        return hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()

    @F.pandas_udf("array<string>")
    def of(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [one(k, t) for k, t in zip(a, b, strict=True)] for a, b in zip(kinds, texts, strict=True)])

    return of


def messages(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(s["type"], F.lit(":"), normalize(s["text"])))


def entity_keys(spans: Column, key: str, native: bool = True) -> Column:
    """The first ten hex digits for each span: equal for equal type, text and key."""
    if native:
        return F.transform(messages(spans), lambda m: F.left(hmac_sha256(key, m), F.lit(10)))
    return F.transform(keyed_udf(key)(F.transform(spans, lambda s: s["type"]), F.transform(spans, lambda s: s["text"])), lambda h: F.left(h, F.lit(10)))


def seed(entity_key: Column) -> Column:
    return F.conv(entity_key, 16, 10).cast("bigint")


def shape_preserving(c: Column) -> Column:
    return F.translate(c, _FROM, _TO)


def _pick(values: tuple[str, ...], n: Column, by: int = 1) -> Column:
    """One of the values, by the part of n above ``by``."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(n / by) % len(values) + 1).cast("int"))


def _number(n: Column, by: int, size: int, least: int = 0) -> Column:
    return (F.floor(n / by) % size + least).cast("string")


def _person(n: Column, sep: str = " ") -> Column:
    return F.concat(_pick(_FIRST, n), F.lit(sep), _pick(_LAST, n, len(_FIRST)))


#: Surrogates of named kinds, from a number that the key and the text give. Addresses are of ranges kept for examples.
NAMED = {
    "PERSON": _person,
    "PHONE": lambda n: F.concat(F.lit("021 555 "), _number(n, 1, 9000, 1000)),
    "EMAIL": lambda n: F.concat(F.lower(_person(n, ".")), _number(n, 1000, 100), F.lit("@example.com")),
    "URL": lambda n: F.concat(F.lit("https://www.example.org/"), F.lower(F.hex(n % 16777216))),
    "IP": lambda n: F.concat(_pick(("192.0.2.", "198.51.100.", "203.0.113."), n, 254), _number(n, 1, 254, 1)),
    "LOCATION": lambda n: F.concat(_number(n, 1, 400, 1), F.lit(" "), _pick(_ROADS, n, 400), F.lit(" "), _pick(_KINDS, n, 4400)),
    "ORG": lambda n: F.concat(_pick(_ROADS, n), F.lit(" "), _pick(_LAST, n, len(_ROADS)), F.lit(" "), _pick(_CARE, n, 11 * len(_LAST))),
}


def surrogate(kind: Column, text: Column, entity_key: Column) -> Column:
    n = seed(entity_key)
    out = F.concat(F.lit("["), kind, F.lit(":"), entity_key, F.lit("]"))
    for k, make in NAMED.items():
        out = F.when(kind == k, F.when(make(n) == text, make(n + 1)).otherwise(make(n))).otherwise(out)
    out = F.when(kind == "DATE", F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), ((n % 365) * 3).cast("int")), "dd/MM/yyyy")).otherwise(out)
    out = F.when(kind == "POSTCODE", (n % 9000 + 1000).cast("string")).otherwise(out)
    out = F.when(kind == "AGE", (n % 90 + 10).cast("string")).otherwise(out)
    return F.when(kind.isin(*SHAPED), shape_preserving(text)).otherwise(out)


def replacements(spans: Column, strategy: str, key: str | None = None, native: bool = True) -> Column:
    """The string for each span."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "mask":
        return F.transform(spans, lambda s: F.concat(F.lit("[REDACTED:"), s["type"], F.lit("]")))
    if not key:
        raise ValueError(f"{strategy} needs a key")
    keys = entity_keys(spans, key, native)
    if strategy == "hash":
        return F.zip_with(spans, keys, lambda s, k: F.concat(F.lit("["), s["type"], F.lit(":"), k, F.lit("]")))
    return F.zip_with(spans, keys, lambda s, k: surrogate(s["type"], s["text"], k))


def redact(text: Column, spans: Column, strings: Column) -> Column:
    """The text with sorted, disjoint spans replaced."""
    end_before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["end"])
    gaps = F.transform(spans, lambda s, i: F.struct(end_before(i).alias("start"), s["start"].alias("end"), F.get(strings, i).alias("r")))
    changed = near_each(text, gaps, lambda g, local, base: F.concat(piece(local, g["start"] - base, g["end"] - base), g["r"]))
    out = F.concat(F.array_join(changed, ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(out)


def audit(spans: Column) -> Column:
    """``array<struct<type,count>>`` by type name: counts only, never values."""
    kinds = F.transform(spans, lambda s: s["type"])
    return F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("type"), F.size(F.filter(kinds, lambda x: x == k)).alias("count")))

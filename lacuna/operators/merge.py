"""Candidate filter and the overlap merge: a left fold that remembers one span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.spans import SPAN, finditer, let, near_each, numbered, piece, scan

# Precedence of layers, priority of types, forms of redacted tokens.
PRECEDENCE = {"rule": 3, "ner": 2, "llm": 1}
PRIORITY = {"NHI": 10, "MEDICARE": 10, "IHI": 10, "MRN": 9, "ID": 8, "EMAIL": 7, "URL": 7, "IP": 7, "PHONE": 6, "DATE": 5, "POSTCODE": 4, "AGE": 3, "LOCATION": 2, "ORG": 2, "PERSON": 2}
REDACTED_TOKEN = r"\[REDACTED:[A-Z]+\]|\[[A-Z]+:[0-9a-f]{10}\]"


def _case(key: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def filter_redacted(text: Column, spans: Column) -> Column:
    """Drop spans inside a token that redaction wrote; spans that straddle one stay."""
    tokens = F.transform(finditer(text, f"(?:{REDACTED_TOKEN})", "U"), lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("stop"), F.lit(-1).alias("i")))
    starts = lambda x: F.transform(x, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), i.alias("i")))

    def outside(x: Column) -> Column:
        """Places of the spans that end behind the last token begun before them: tokens are disjoint, so no other holds them."""
        step = lambda state, e: F.when(e["i"] < 0, F.struct((-e["stop"]).alias("upto"))).otherwise(state)
        emit = lambda state, e: F.when((e["i"] >= 0) & (-e["stop"] > state["upto"]), F.array(e["i"])).otherwise(F.array().cast("array<int>"))
        # of equal bounds the token stands first (its place is -1), and of equal starts the longer one, so a token before what it holds
        return scan(F.array_sort(F.concat(tokens, starts(x))), F.struct(F.lit(0).alias("upto")), step, emit, "int")["out"]

    kept = let(spans, lambda x: F.when(F.size(x) == 0, x).otherwise(F.transform(F.array_sort(outside(x)), lambda i: F.get(x, i))))
    return F.when(F.contains(text, F.lit("[")), kept).otherwise(spans)


def merge_spans(text: Column, spans: Column, refill: bool = True) -> Column:
    """Sorted, disjoint spans.

    Order: start, higher layer, higher score, longer, first found. Against the span before it, a span that
    overlaps it loses or wins by layer; in one layer equal types unite, else the longer wins, then the type
    of higher priority or the higher score. United spans take their text from the note again; with
    ``refill=False`` it is left empty.
    """
    key = lambda s: F.struct(s["start"].alias("a"), (-_case(s["source"], PRECEDENCE)).alias("b"), (-s["score"]).alias("c"), (-s["end"]).alias("d"), s["seq"].alias("e"), s.alias("span"))
    ordered = F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["span"])
    behind = lambda last, s: last.isNull() | (s["start"] >= last["end"])

    def step(last: Column, s: Column) -> Column:
        p, q = _case(s["source"], PRECEDENCE), _case(last["source"], PRECEDENCE)
        n, m = s["end"] - s["start"], last["end"] - last["start"]
        union = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            last["type"].alias("type"),
            F.lit(None).cast("string").alias("text"),
            F.greatest(last["score"], s["score"]).alias("score"),
            last["source"].alias("source"),
            F.coalesce(last["recognizer"], s["recognizer"]).alias("recognizer"),
            last["seq"].alias("seq"),
        )
        wins = (n > m) | ((n == m) & ((_case(s["type"], PRIORITY) > _case(last["type"], PRIORITY)) | (s["score"] > last["score"])))
        return (
            F.when(behind(last, s) | (p > q), s)
            .when(p < q, last)
            .when(s["type"] == last["type"], union)
            .when(wins, s)
            .otherwise(last)
        )

    emit = lambda last, s: F.when(last.isNotNull() & behind(last, s), F.array(last)).otherwise(F.array().cast(f"array<{SPAN}>"))
    merged = let(scan(ordered, F.lit(None).cast(SPAN), step, emit, SPAN), lambda r: F.concat(r["out"], F.array(r["state"])))
    if refill:
        own = lambda s, local, base: F.when(s["text"].isNull(), s.withField("text", piece(local, s["start"] - base, s["end"] - base))).otherwise(s)
        united = lambda x: F.when(F.exists(x, lambda s: s["text"].isNull()), near_each(text, x, own)).otherwise(x)
    else:
        united = lambda x: F.transform(x, lambda s: s.withField("text", F.coalesce(s["text"], F.lit(""))))
    return F.when(F.size(spans) < 2, spans).otherwise(let(merged, united))


def overlaps(spans: Column) -> Column:
    """Whether neighbours overlap, which they never do after a merge."""
    pairs = F.arrays_zip(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))).alias("x"), F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0))).alias("y"))
    return F.exists(pairs, lambda p: p["y"]["start"] < p["x"]["end"])


def disjoint(spans: Column) -> Column:
    """The spans, or an error where neighbours overlap."""
    return F.when(overlaps(spans), F.raise_error(F.lit("spans overlap after the merge"))).otherwise(spans)


def layers(*spans: Column) -> Column:
    """Candidates of all layers in the order given, numbered."""
    return numbered(F.concat(*spans))

"""Span-level precision, recall and F1 against labels, strict and relaxed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import let

# The types that count as identifiers, and the gate on their relaxed recall.
IDENTIFIERS = ("NHI", "MEDICARE", "IHI", "MRN", "PHONE", "EMAIL", "DATE", "IP", "URL", "POSTCODE", "ID")
RELAXED_IOU, RECALL_GATE = 0.5, 0.95


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two spans; 0 without an intersection."""
    both = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    return F.when(both > 0, both / (F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"]))).otherwise(0.0)


def matches(gold: Column, pred: Column, strict: bool) -> Column:
    """How many pairs a greedy one-to-one matching takes, by (IoU, gold place, predicted place) descending.

    Both arrays are of one note and one type, so the pairs stay within a row. Equal spans are the first pairs taken: where
    neither array has a span twice they are counted as a set, and only what is left is paired.
    """
    none = F.lit(0)
    keys = lambda a: F.transform(a, lambda s: s["start"].cast("long") * F.lit(1 << 32) + s["end"])
    once = lambda a, k: (F.size(F.array_distinct(k)) == F.size(a)) & F.forall(a, lambda s: s["start"].isNotNull() & (s["end"].isNotNull() if strict else s["end"] > s["start"]))

    def by_keys(x: Column) -> Column:
        rest = lambda a, same: F.filter(a, lambda s: ~F.array_contains(same, s["start"].cast("long") * F.lit(1 << 32) + s["end"]))
        more = lambda same: F.when(F.size(same) == F.least(F.size(gold), F.size(pred)), none).otherwise(_greedy(rest(gold, same), rest(pred, same), strict))
        count = (lambda same: F.size(same)) if strict else (lambda same: F.size(same) + more(same))
        return F.when(once(gold, x["g"]) & once(pred, x["p"]), let(F.array_intersect(x["g"], x["p"]), count)).otherwise(_greedy(gold, pred, strict))

    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), none).otherwise(let(F.struct(keys(gold).alias("g"), keys(pred).alias("p")), by_keys))


def _greedy(gold: Column, pred: Column, strict: bool) -> Column:
    with_place = lambda a: F.transform(a, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    pairs = F.flatten(F.transform(with_place(gold), lambda g: F.transform(with_place(pred), lambda p: F.struct(
        iou(g, p).alias("iou"), g["i"].alias("g"), p["i"].alias("p"), ((g["start"] == p["start"]) & (g["end"] == p["end"])).alias("same")))))
    fits = F.filter(pairs, (lambda x: x["same"]) if strict else (lambda x: x["iou"] >= RELAXED_IOU))
    ordered = F.sort_array(F.transform(fits, lambda x: F.struct(x["iou"].alias("iou"), x["g"].alias("g"), x["p"].alias("p"))), asc=False)
    zero = F.struct(F.array().cast("array<int>").alias("gs"), F.array().cast("array<int>").alias("ps"))
    free = lambda acc, x: ~F.array_contains(acc["gs"], x["g"]) & ~F.array_contains(acc["ps"], x["p"])
    take = lambda acc, x: F.struct(F.when(free(acc, x), F.concat(acc["gs"], F.array(x["g"]))).otherwise(acc["gs"]).alias("gs"), F.when(free(acc, x), F.concat(acc["ps"], F.array(x["p"]))).otherwise(acc["ps"]).alias("ps"))
    return F.aggregate(ordered, zero, take, lambda acc: F.size(acc["gs"]))


def score_notes(notes: DataFrame, gold_col: str = "gold", pred_col: str = "spans", id_col: str = "note_id") -> DataFrame:
    """Counters for each note and type: gold, pred, relaxed_tp, strict_tp. Row-local, no join."""
    gold, pred = F.col(gold_col), F.col(pred_col)
    kinds = F.array_sort(F.array_distinct(F.concat(F.transform(gold, lambda s: s["type"]), F.transform(pred, lambda s: s["type"]))))
    # bounds alone go to the rows of types, each type's own
    of = lambda spans, kind: F.transform(F.filter(spans, lambda s: s["type"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    by_kind = F.transform(kinds, lambda k: F.struct(k.alias("type"), of(gold, k).alias("g"), of(pred, k).alias("p")))
    rows = notes.select(F.col(id_col).alias("note_id"), F.explode(by_kind).alias("k")).select("note_id", "k.type", "k.g", "k.p")
    return rows.select("note_id", "type", F.size("g").alias("gold"), F.size("p").alias("pred"), matches(F.col("g"), F.col("p"), False).alias("relaxed_tp"), matches(F.col("g"), F.col("p"), True).alias("strict_tp"))


_COUNTERS = ("gold", "pred", "relaxed_tp", "strict_tp")


def _ratios(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    for kind in ("relaxed", "strict"):
        tp = f"{kind}_tp"
        df = df.withColumn(f"{kind}_p", share(tp, "pred")).withColumn(f"{kind}_r", share(tp, "gold"))
        p, r = F.col(f"{kind}_p"), F.col(f"{kind}_r")
        df = df.withColumn(f"{kind}_f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return df


def per_type(scored: DataFrame) -> DataFrame:
    return _ratios(scored.groupBy("type").agg(*[F.sum(c).alias(c) for c in _COUNTERS]))


def micro(scored: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """One row over all types, or over those given."""
    some = scored.where(F.col("type").isin(*types)) if types else scored
    return _ratios(some.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS]))


def report(scored: DataFrame) -> str:
    """Markdown: a row for each type, then identifiers and all types. At most one row for each type reaches the driver."""
    rows = sorted(per_type(scored).collect(), key=lambda r: r["type"])
    rows += [micro(scored).select(F.lit("**micro overall**").alias("type"), "*").first(), micro(scored, IDENTIFIERS).select(F.lit("**identifiers**").alias("type"), "*").first()]
    names = ("type", "gold", "pred", "relaxed_p", "relaxed_r", "relaxed_f1", "strict_p", "strict_r", "strict_f1")
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def passes_gate(scored: DataFrame) -> bool:
    return micro(scored, IDENTIFIERS).first()["relaxed_r"] >= RECALL_GATE

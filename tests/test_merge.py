"""The merge against a plain Python model, and the filter of redacted tokens."""

import random

from pyspark.sql import functions as F

from lacuna.functions.spans import SPANS
from lacuna.operators import merge

PREC, PRIO = {"rule": 3, "ner": 2, "llm": 1}, merge.PRIORITY


def model(spans, text):
    out = []
    for s in sorted(spans, key=lambda s: (s["start"], -PREC[s["source"]], -s["score"], -s["end"], s["seq"])):
        if not out or s["start"] >= out[-1]["end"]:
            out.append(s)
            continue
        last = out[-1]
        if PREC[s["source"]] != PREC[last["source"]]:
            if PREC[s["source"]] > PREC[last["source"]]:
                out[-1] = s
        elif s["type"] == last["type"]:
            end = max(s["end"], last["end"])
            out[-1] = {**last, "end": end, "text": text[last["start"] : end], "score": max(s["score"], last["score"])}
        else:
            n, m = s["end"] - s["start"], last["end"] - last["start"]
            if n > m or (n == m and (PRIO[s["type"]] > PRIO[last["type"]] or s["score"] > last["score"])):
                out[-1] = s
    return out


def test_random_lists(spark):
    rng, text, rows = random.Random(7), "abcdefghij" * 4, []
    for i in range(400):
        spans = []
        for k in range(rng.randrange(9)):
            a = rng.randrange(30)
            b = a + rng.randrange(1, 9)
            spans.append({"start": a, "end": b, "type": rng.choice(list(PRIO)), "text": text[a:b], "score": rng.choice([0.5, 0.6, 0.75, 0.9]), "source": rng.choice(list(PREC)), "recognizer": "r", "seq": k})
        rows.append((i, spans))
    df = spark.createDataFrame(rows, f"i int, s {SPANS}")
    got = df.select("i", merge.merge_spans(F.lit(text), F.col("s")).alias("m"), merge.overlaps(merge.merge_spans(F.lit(text), F.col("s"))).alias("o")).collect()
    for r in got:
        assert [x.asDict() for x in r.m] == model(rows[r.i][1], text)
        assert not r.o


def test_filter_redacted(spark):
    text = "[REDACTED:NHI] x [PHONE:0123456789] 12"
    span = lambda a, b: {"start": a, "end": b, "type": "ID", "text": text[a:b], "score": 1.0, "source": "rule", "recognizer": "r", "seq": 0}
    df = spark.createDataFrame([(text, [span(1, 9), span(10, 16), span(24, 34), span(36, 38)])], f"t string, s {SPANS}")
    got = df.select(merge.filter_redacted(F.col("t"), F.col("s")).alias("s")).first().s
    assert [(x.start, x.end) for x in got] == [(10, 16), (36, 38)]


def test_filter_redacted_by_all_pairs(spark):
    """Random spans against tokens, many of both."""
    rng = random.Random(11)
    text = "".join(rng.choice(["[REDACTED:NHI]", "[PHONE:0123456789]", "[x", " word "]) for _ in range(400))
    tokens = [m.span() for m in __import__("re").finditer(merge.REDACTED_TOKEN, text)]
    made = []
    for k in range(1500):
        a = rng.randrange(len(text) - 20)
        made.append({"start": a, "end": a + rng.randrange(1, 20), "type": "ID", "text": "", "score": 1.0, "source": "rule", "recognizer": "r", "seq": k})
    made += [{**made[0], "start": a, "end": b, "seq": 2000 + i} for i, (a, b) in enumerate(tokens[:20])]
    got = spark.createDataFrame([(text, made)], f"t string, s {SPANS}").select(merge.filter_redacted(F.col("t"), F.col("s")).alias("s")).first().s
    assert [x.seq for x in got] == [s["seq"] for s in made if not any(a <= s["start"] and s["end"] <= b for a, b in tokens)]

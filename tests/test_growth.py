"""Plans whose work has to grow with the table, on all cores, and none of it on the driver."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import spans
from lacuna.operators import apart, recognizers, tagger
from lacuna.queries import QUERIES
from lacuna.sources import generate

SF = "/root/testdata/sf0.001"


def plan(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_strings_and_ranks_of_all_notes_are_not_broadcast(spark):
    # the planner knows these to be small, as it takes notes made of a table of keys to be
    rows = spark.range(50).selectExpr("id", "0 AS at", "'PERSON' AS type", "sha2(string(id), 256) AS digest", "concat('name ', id) AS text")
    made = apart.surrogates(rows, apart.dictionary(rows), "key")
    # frequent entities and sums of buckets are bounded, the dictionary isn't
    assert plan(made).count("SortMergeJoin") == 1
    found = spark.range(1).selectExpr("id AS note_id", "'Jane Smith' AS text", "array(named_struct('start', 0, 'end', 10, 'type', 'PERSON', 'text', 'Jane Smith')) AS spans")
    out, _ = apart.redact_apart(found, "k")
    assert plan(out).count("SortMergeJoin") == 2 and out.count() == 1


@pytest.mark.parametrize("name", ["corpus_offset_check", "id_validation"])
def test_notes_are_made_after_their_table_is_dealt_out(spark, name):
    text = plan(QUERIES[name](spark, SF), "optimizedPlan")
    assert "Repartition" in text
    assert not any("aggregate(" in below.split("Relation")[0] for below in text.split("Repartition")[1:])


def test_labels_of_made_notes(spark):
    keys = spark.range(40).select(F.col("id").alias("c_custkey"))
    for df in (generate.generated_notes(keys), generate.shaped_notes(keys), generate.prose_notes(keys)):
        got = df.collect()
        assert sorted(r.note_id for r in got) == list(range(40)) and all(r.text[g.start : g.end] == g.text for r in got for g in r.gold)


def test_right_lines_are_tagged_together(monkeypatch):
    """As many searches as wrong lines and runs of right ones, and the weights of learning line by line."""
    texts = [f"Seen with {a} {b}.\nLives in {b}ton.\nStable today." for a in ("Anna", "Bo", "Cy") for b in ("Bell", "Ford", "Hill", "Lee")] * 60
    gold = [[(10, t.index("\n") - 1, "PERSON"), (t.index("in ") + 3, t.rindex("\n") - 1, "LOCATION")] for t in texts]
    calls, viterbi = [], tagger.viterbi
    monkeypatch.setattr(tagger, "viterbi", lambda *a: calls.append(len(a[0])) or viterbi(*a))

    def learnt(run):
        monkeypatch.setattr(tagger, "RUN", run)
        learner = tagger._Learner(tagger.Tagger(np.zeros(0, np.uint64), np.zeros((1, tagger.N)), np.zeros((tagger.N + 1, tagger.N))))
        lines = tagger.Lines(texts, {})
        learner.learn(lines, tagger.gold_tags(lines, gold))
        return learner.rows().to_pydict()

    one_by_one, together = learnt(1), (calls.clear(), learnt(512))[1]
    assert one_by_one == together and len(calls) < len(texts) // 4


@pytest.mark.parametrize("cut", [False, True])
def test_a_text_is_searched_once_with_few_hits_and_many(spark, monkeypatch, cut):
    texts = ["x" * i + "no 12 äé 345, " * i + odd for i in (0, 1, 2, 15, 16, 17, 40) for odd in ("", "\u0001 7", "\u0002 8\u0001")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = {}
    for few in (16, 0):
        monkeypatch.setattr(spans, "FEW", few)
        out = df.select("t", spans.finditer(F.col("t"), r"(\b\d)(\d*)" if cut else r"\b\d+", "U", cut).alias("h"))
        assert "RLIKE" not in plan(out, "optimizedPlan")
        found[few] = {r.t: r.h for r in out.collect()}
    assert found[16] == found[0] and found[16][None] == []
    for t in texts:
        assert [(h.start, h.end, h["head"] + h["tail"]) for h in found[16][t]] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\b\d+", t)]


def test_lines_with_postcodes_are_found_by_a_full_stop(spark):
    """A class of all that ends no line took most of the time of a whole plan; every end of a line still ends one."""
    ends = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
    texts = [f"ward 4021{e}12 Rata STREET, 4122 é 5123-1234{e}or 6021{f}ſtreet 7021{e}streets 8021" for e in ends for f in ends]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", recognizers.postcodes(F.col("t")).alias("p"))
    assert "[^" not in plan(df, "optimizedPlan")
    for r in df.collect():
        assert [s.text for s in r.p] == ["4122", "5123-1234", "7021"] and all(r.t[s.start : s.end] == s.text for s in r.p)

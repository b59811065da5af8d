"""Surrogates that no two entities share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import apart
from lacuna.plans.deidentify import Config, detect

ROWS = "id long, at int, type string, digest string, text string"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 900, 9000, 65_537])
def test_permutation_of_the_whole_space(size):
    got = apart.permuted(np.arange(size), size, b"key")
    assert sorted(got.tolist()) == list(range(size))
    if size > 100:
        assert (got != np.arange(size)).mean() > 0.9 and (got != apart.permuted(np.arange(size), size, b"other")).mean() > 0.9
        assert abs(np.corrcoef(np.arange(size), got)[0, 1]) < 0.15


@pytest.mark.parametrize("kind", sorted(apart.SPACES))
def test_places_have_surrogates_of_their_own(spark, kind):
    size = apart.SPACES[kind][0]
    some = spark.range(60_000).select((F.col("id") if size < 60_000 else F.col("id") * (size // 60_000)).alias("p"))
    some = some.union(spark.range(2000).select(F.col("id") * max(size // 1000, 1) + 3)).distinct()
    made = apart.surrogate_at(F.lit(kind), F.col("p"), F.lit("no such text"))
    n, d = some.select(made.alias("s")).agg(F.count("s"), F.countDistinct("s")).first()
    assert n == d == some.count()


def test_a_text_is_never_its_own_surrogate(spark):
    rows = spark.range(9000).select("id", F.concat(F.lit("021 555 "), (F.col("id") + 1000).cast("string")).alias("text"))
    got = rows.select("text", apart.surrogate_at(F.lit("PHONE"), F.col("id"), F.col("text")).alias("s")).collect()
    assert all(r.s == f"{r.text} ext 1" for r in got)


def _digests(n, kind="PERSON", of=0):
    import hashlib

    return [(i, 0, kind, hashlib.sha256(f"{of}:{i}".encode()).hexdigest(), f"name {i}") for i in range(n)]


def test_ranks_are_dense_and_kept(spark):
    people, phones = _digests(3000), _digests(10, "PHONE")
    first = spark.createDataFrame([*people, *people[:500], *phones, (1, 2, "DATE", "00", "x")], ROWS)
    old = apart.dictionary(first)
    ranks = {(r.type, r.digest): r.rank for r in old.collect()}
    assert sorted(v for (t, _), v in ranks.items() if t == "PERSON") == list(range(3000))
    assert sorted(v for (t, _), v in ranks.items() if t == "PHONE") == list(range(10))
    assert {r.n for r in old.where("type = 'PERSON'").collect()} == {1, 2} and old.where("type = 'DATE'").isEmpty()
    more = spark.createDataFrame([*people[:5], *_digests(700, of=1), *_digests(3, "ORG")], ROWS)
    grown = {(r.type, r.digest): r.rank for r in apart.dictionary(more, old).collect()}
    assert grown.items() >= ranks.items()
    assert sorted(v for (t, _), v in grown.items() if t == "PERSON") == list(range(3700))
    assert sorted(v for (t, _), v in grown.items() if t == "ORG") == [0, 1, 2]
    assert apart.dictionary(first.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [10_000, 3])
def test_frequent_entities(spark, monkeypatch, hot):
    monkeypatch.setattr(apart, "HOT", hot)
    rows = [(i, 0, "PERSON", "ab" * 32, "Jo") for i in range(400)] + _digests(200) + _digests(12_000, "PHONE")
    df = spark.createDataFrame(rows, ROWS)
    got = apart.surrogates(df, apart.dictionary(df), "key").collect()
    assert len(got) == len(rows)
    jo = {r.surrogate for r in got if r.text == "Jo"}
    others = [r.surrogate for r in got if r.text != "Jo"]
    assert len(jo) == 1 and len({*others}) == len(others) and not jo & {*others}  # more phones than the space has


def test_notes(spark):
    texts = [(1, "Patient: Jane Smith\nEmail a.b@example.org on 01/02/2020"), (2, "Patient: Jane Smith\nEmail c.d@example.org"), (3, "nothing"), (4, None), (5, "Patient: Ann Lee, a.b@example.org, c.d@example.org")]
    df = spark.createDataFrame(texts, "note_id long, text string")
    found = detect(df, Config(key="k"))
    out, ranks = apart.redact_apart(found, "k")
    assert out.columns == [*found.columns, "redacted_text"]
    got = {r.note_id: r.redacted_text for r in out.collect()}
    assert got[3] == "nothing" and got[4] is None and len(got) == 5
    person = lambda i: got[i].split("\n")[0].split(",")[0]
    assert person(1) == person(2) != person(5) and "Smith" not in got[1] and "example.org" not in got[1] + got[2] + got[5]
    mails = [w.strip(",") for w in got[5].split() if "@" in w]
    assert len({*mails}) == 2 and mails[0] in got[1] and mails[1] in got[2]
    again, grown = apart.redact_apart(found.where("note_id = 5"), "k", ranks)
    assert again.first().redacted_text == got[5] and grown.count() == ranks.count()
    assert apart.redact_apart(found.limit(0), "k")[0].count() == 0
    for bad in ([(None, "a.b@example.org")], [(1, "a.b@example.org")] * 2):
        with pytest.raises(Exception, match="id"):
            apart.redact_apart(detect(spark.createDataFrame(bad, "note_id long, text string")), "k")[0].collect()
    with pytest.raises(ValueError):
        apart.redact_apart(found, "")

"""Search with offsets, and the rule recognizers."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lacuna.functions import checksums
from lacuna.functions.spans import finditer, settled
from lacuna.operators import recognizers as R

TEXTS = ["", "abc 12 de 345", "\U0001f600 12x 99", "é12345 77", "a\u000112\u0002 3", "12\n\n34", "no digits"]


def test_finditer_agrees_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: [(h["start"], h["end"]) for h in r.h] for r in df.select("i", finditer(F.col("t"), r"\b\d+\b").alias("h")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == [m.span() for m in re.finditer(r"\b\d+\b", t)], t


def test_finditer_cut_gives_the_second_group(spark):
    df = spark.createDataFrame([("\U0001f600 Phone: 555 12, phone 99 1",)], "t string")
    text = df.first().t
    got = df.select(finditer(F.col("t"), r"(phone[: ]+)([0-9 ]+[0-9])", "iU", True).alias("h")).first().h
    assert [(h["mid"], h["end"]) for h in got] == [m.span(2) for m in re.finditer(r"(phone[: ]+)([0-9 ]+[0-9])", text, re.I)]


@pytest.mark.parametrize(("check", "value", "valid"), [
    ("nhi_valid", "ABC1235", True), ("nhi_valid", "ABC1234", False), ("nhi_valid", "abc1235", False), ("nhi_valid", "", False),
    ("medicare_valid", "3189977021", True), ("medicare_valid", "3189977012", False), ("medicare_valid", "31899770", False),
    ("luhn_valid", "4532015112830366", True), ("luhn_valid", "4532015112830367", False), ("luhn_valid", "0", False),
    ("ihi_valid", "8003607906279049", True), ("ihi_valid", "8003 6079 0627 9049", True), ("ihi_valid", "8003607906279048", False),
])
def test_checksums(spark, check, value, valid):
    assert spark.range(1).select(getattr(checksums, check)(F.lit(value))).first()[0] is valid


def spans(spark, text, regions=("NZ", "AU")):
    row = spark.createDataFrame([(text,)], "t string").select(R.rule_spans(F.col("t"), regions).alias("s")).first()
    for s in row.s:
        assert text[s["start"] : s["end"]] == s["text"]
    return {(s["type"], s["text"]) for s in row.s}


def test_rules_on_one_note(spark):
    text = "NHI: ABC1235, ABC1234. Phone: 555-711-5374\nMobile 021 242 2679 or 0410 877 925\nMRN: 123456 born 1992-04-30, 30/2/1990, 3 May 1980\nSeen 45 yo\n12 Station St, Newtown 2220"
    got = spans(spark, text)
    assert {("NHI", "ABC1235"), ("PHONE", "555-711-5374"), ("PHONE", "021 242 2679 "[:-1]), ("PHONE", "0410 877 925"), ("MRN", "123456"), ("DATE", "1992-04-30"), ("DATE", "3 May 1980"), ("AGE", "45 yo"), ("LOCATION", "12 Station St")} <= got
    assert ("NHI", "ABC1234") not in got and ("DATE", "30/2/1990") not in got


def test_phones_of_further_regions_and_free_numbers(spark):
    found = lambda text, *regions: {t for k, t in spans(spark, text, regions) if k == "PHONE"}
    assert found("call 0508 222 333 or 0800 123 4567", "NZ") == {"0508 222 333", "0800 123 4567"}
    assert found("call 1300 123 456, 1800 654 321", "AU") == {"1300 123 456", "1800 654 321"}
    assert found("on +44 20 7946 0018 or 07700 900123", "GB") == {"+44 20 7946 0018", "07700 900123"}
    assert found("on +49 30 123456", "DE") == {"+49 30 123456"} and found("on +49 30 123456", "FR") == set()
    with pytest.raises(ValueError, match="XX"):
        R.phone_region("XX")


def test_addresses_of_machines_and_long_suffixes(spark):
    got = spans(spark, "at 2001:db8::1, ::1 and 10.0.0.300 or 10.0.0.30; x@y.international at std::vector, 12:30:45, see a.govt.nz and clinic.org.au/x")
    assert {t for k, t in got if k == "IP"} == {"2001:db8::1", "::1", "10.0.0.30"}
    assert ("EMAIL", "x@y.international") in got and {t for k, t in got if k == "URL"} == {"a.govt.nz", "clinic.org.au/x"}


def test_generic_ids_need_their_context(spark):
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    assert ("ID", uuid) in spans(spark, f"resource id {uuid}")
    assert ("ID", uuid) not in spans(spark, f"build {uuid}")
    assert ("ID", "123-45-6789") in spans(spark, "card 123-45-6789")


def test_postcodes_need_an_address_word_on_their_line(spark):
    got = spans(spark, "code 4021\nAddress 7012\rcity 90210-1234")
    assert {x for x in got if x[0] == "POSTCODE"} == {("POSTCODE", "7012"), ("POSTCODE", "90210-1234")}


def test_long_word_runs_do_not_exhaust_the_stack(spark):
    spans(spark, "12 " + "word " * 20_000 + "street")


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [len(r.s) for r in df.select(R.rule_spans(F.coalesce("t", F.lit(""))).alias("s")).collect()] == [0, 0]


def test_time_grows_with_matches_not_with_their_square(spark):
    """One note with 128,000 spans that are found, merged and masked takes less than eight times as long as one with a quarter of them (a square: sixteen)."""
    import time

    from lacuna.operators import merge, redact

    def seconds(n):
        text = "".join(f"mail a{i}@b.com on {i % 28 + 1}/03/2001; " for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        df = settled(df, "spans", merge.layers(R.EMAIL.spans(F.col("text")), R.DATE.spans(F.col("text"))))
        df = settled(df, "spans", merge.merge_spans(F.col("text"), F.col("spans")))
        df = settled(df, "strings", redact.replacements(F.col("spans"), "mask"))
        began = time.perf_counter()
        row = df.select("spans", redact.redact(F.col("text"), F.col("spans"), F.col("strings")).alias("masked")).first()
        took = time.perf_counter() - began
        assert len(row.spans) == 2 * n and row.masked == "mail [REDACTED:EMAIL] on [REDACTED:DATE]; " * n
        return took

    seconds(1000)
    assert seconds(64_000) < 8 * max(1, seconds(16_000))


def test_blocks_change_nothing(spark, monkeypatch):
    """Search, surroundings, first bounds and texts that have the marks themselves, over blocks of three."""
    from lacuna.functions import spans as S

    note = "resource id 01234567-89ab-cdef-0123-456789abcdef \x01 Address 7012 \x02 city Newtown 2220, " * 9 + "x" * 80 + " 01234567-89ab-cdef-0123-456789abcdee"
    want = spans(spark, note)
    monkeypatch.setattr(S, "BLOCK", 3)
    assert spans(spark, note) == want and len(want) >= 4
    assert ("ID", "01234567-89ab-cdef-0123-456789abcdee") not in want


def test_numbers_of_plans_and_the_region_check(spark):
    found = lambda text, *regions: [t for k, t in sorted(spans(spark, text, regions)) if k == "PHONE"]
    assert found("Paris 01 42 68 53 00, 06 12 34 56 78, +33 1 42 68 53 00, +49 30 901820", "FR") == ["+33 1 42 68 53 00", "01 42 68 53 00", "06 12 34 56 78"]
    assert found("416-555-0123 and 212-555-0123", "US") == ["212-555-0123"] and found("416-555-0123 and 212-555-0123", "CA") == ["416-555-0123"]
    assert found("+49 (0)30 901820 or 12 34", "DE") == ["+49 (0)30 901820"]


def test_suffix_rules_of_a_file(spark, tmp_path):
    from lacuna.functions.domains import Suffixes, read_rules

    (tmp_path / "rules").write_text("// a list\nzz  note\n\n*.yy\n!in.yy\na.b.zz\n")
    own = Suffixes(read_rules(str(tmp_path / "rules")))
    hosts = {"zz": 0, "q.zz": 1, "b.zz": 1, "a.b.zz": 0, "q.a.b.zz": 1, "x.yy": 0, "q.x.yy": 1, "in.yy": 1, "yy": 0, "q.com": 0, "": 0}
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", own.registered(F.col("h")).cast("int").alias("r"))
    assert {r.h: r.r for r in df.collect()} == hosts
    with pytest.raises(ValueError, match="rules"):
        Suffixes(f"s{i}" for i in range(20_001))


def test_what_a_match_begins_with_costs_none(spark):
    """A pattern led by what its matches begin with finds what the pattern alone finds; digits and letters beyond ASCII too."""
    text = "١٢/٠٣/٢٠٢٠ 1/2/2020 3 May 2021 ١٢.٣٤.٥٦.٧٨ 1.2.3.4 x::ffff:1.2.3.4 fe80::1 mrn ABCDEF01-0000-0000-0000-000000000000 99 YO x12 yo 12 years old 5 High St 123-45-6789 2123 45670 1 8003601234567890 (03) 9123 4567 +64 21 555 1234"
    rows = spark.createDataFrame([(text,), (text.lower(),), (text.replace("1", "١"),), ("é" + text.replace(" ", "é"),)], "text string")
    specs = [R.phone_region("AU"), *(s for s in vars(R).values() if isinstance(s, R.RecognizerSpec) and s.first)]
    assert len(specs) == 10
    for spec in specs:
        for r in rows.select(spec.spans(F.col("text")).alias("a"), replace(spec, first=None).spans(F.col("text")).alias("b")).collect():
            assert r.a == r.b


@pytest.mark.parametrize("part", ["whole", "first", "second"])
def test_spans_made_at_once(spark, part):
    """F14 to F23: spans of few, many and no hits are made from the pieces of the marked text, with marks in the text too."""
    from lacuna.functions.spans import find_spans, span_sql

    pattern = r"([a-z]+: )([0-9]+)"
    texts = ["", "none", "ab: 12", "\U0001f600 ab: 12 é cd: 345", "x\u0001ab: 1\u0002 q: 22\u0001", "k: 7, " * 15 + "k: 8", "k: 7, " * 200 + "\u0001", "k: 7, " * 17]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", find_spans(F.col("t"), pattern, "U", part, span_sql("ID", 0.5, "r", "ner")).alias("h")).collect()
    group = {"whole": 0, "first": 1, "second": 2}[part]
    for r in got:
        assert [(h.start, h.end, h.text) for h in r.h] == [(*m.span(group), m[group]) for m in re.finditer(pattern, texts[r.i])]
        assert all((h.type, h.score, h.source, h.recognizer, h.seq) == ("ID", 0.5, "ner", "r", 0) for h in r.h)


def test_equal_spans_are_counted_as_sets(spark):
    """F14 to F17, F20: with and without repeated or empty spans the counts are those of the greedy pairing."""
    import random

    from lacuna.operators import evaluate

    rnd = random.Random(3)
    some = lambda: [(a, a + rnd.choice((0, 1, 3, 4))) for a in (rnd.randrange(14) for _ in range(rnd.randint(0, 6)))]
    apart = lambda by: [(9 * x + rnd.choice(by), 9 * x + 5) for x in range(5)]
    rows = [(some(), some()) for _ in range(300)] + [(apart((0,)), apart((0, 1, 4))) for _ in range(100)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g array<struct<start:int,end:int>>, p array<struct<start:int,end:int>>")
    for strict in (True, False):
        count = evaluate.matches(F.col("g"), F.col("p"), strict)
        plain = evaluate._greedy(F.col("g"), F.col("p"), strict)
        got = df.select(count.alias("a"), plain.alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
        assert sum(r.a for r in got) > 100

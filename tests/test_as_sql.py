"""Inputs on which whole queries once differed from their SQL."""

import html

import duckdb
from pyspark.sql import functions as F

from lacuna.plans.deidentify import deidentify
from lacuna.queries import ORACLES, QUERIES
from lacuna.sources import fhir


def test_last_number_of_an_address_begins_no_street(spark):
    texts = {
        "from 65.95.187.205 thtihe st now": "from [REDACTED:IP] thtihe st now",
        "from 65.95.187.205 one two three four Road now": "from [REDACTED:IP] one two three four Road now",
        "1.2.3.4.12 Oak Street": "[REDACTED:IP].[REDACTED:LOCATION]",
        "no 1.12 Oak Street": "no 1.[REDACTED:LOCATION]",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.redacted_text for r in df.transform(deidentify()).collect()} == texts


def test_long_house_numbers_of_bundles(spark):
    bundle = '{"entry":[{"resource":{"resourceType":"Patient","address":[{"line":["%s High Street"],"city":"Perth"}]}}]}'
    df = spark.createDataFrame([(n, bundle % n) for n in ("7", "99999", "100207", "12345678")], "n string, j string").select("n", F.parse_json("j").alias("bundle"))
    got = {r.n: r.redacted_text for r in fhir.deidentify_bundles(df).collect()}
    assert {t.strip().splitlines()[-1] for t in got.values()} == {"Address: [REDACTED:LOCATION], [REDACTED:LOCATION]"} and len(got) == 4


def test_references_that_were_cut_off(spark):
    texts = ["a&&amp b", "a &amp;&amp;lt; &#39; &#39 &copy &copy; &nope; &", "&#x41; &#x41 z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", fhir.unescape(F.col("t"), closed=True).alias("closed"), fhir.unescape(F.col("t")).alias("all")).collect()
    assert {r.t: r.all for r in got} == {t: html.unescape(t) for t in texts}
    assert [{r.t: r.closed for r in got}[t] for t in texts] == ["a&&amp b", "a &&lt; ' &#39 &copy © &nope; &", "A &#x41 z"]


def test_order_lines_of_one_number_are_taken_as_they_lie(spark, tmp_path):
    """A note's last two lines tie in all that the SQL sorts by; the one that lies first in the table is merged first."""
    phone, person = 49, 19  # suppliers of candidates of one length and two types
    rows = [(note, *line) for note, tied in enumerate(((phone, person), (person, phone))) for line in ((0, 1, 1), *((81, s, 2) for s in tied))]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    columns = ["note_id", "begin_at", "end_at", "type", "score", "source"]
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES["merge_spans"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["merge_spans"]).fetchall()) == [(0, 0, 6, "PHONE", 0.5, "rule"), (1, 1, 6, "PHONE", 0.5, "rule")]


def test_words_end_at_letters_beyond_ascii_as_in_the_sql(spark, tmp_path):
    texts = ["call 2043 der chensch stß now", "zu 3280 zuch stöbe", "ß12 Oak Street", "12 Oak Street", "1.2.3.4ß and ü10.0.0.7", "ößa.b@mail.orgß and c@mail.org", "é1.2.3.4.12 Oak Road", "12 Oak \u017ft"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = {r[0]: r[1:] for r in con.execute(ORACLES["deidentify_documents"]).fetchall()}
    got = {r.doc_id: (r.redacted_text, r.n_spans) for r in QUERIES["deidentify_documents"](spark, str(tmp_path)).collect()}
    assert got == sql and sql[0] == ("call [REDACTED:LOCATION]ß now", 1)
    plain = spark.createDataFrame([(texts[0],)], "text string").transform(deidentify()).first()
    assert plain.redacted_text == texts[0]

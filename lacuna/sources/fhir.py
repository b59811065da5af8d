"""Clinical record bundles (FHIR JSON) to note text, with VARIANT columns: no schema, no shuffle.

One row is one bundle. Resources stay an array in bundle order; every section is an array of lines.
Bundles with very many entries go as rows (``entries``, ``text_of_entries``): no array holds more than the lines of one text.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache
from html.entities import html5
from zlib import crc32

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators.ner import _NAME as NAME
from lacuna.operators.recognizers import RecognizerSpec, any_of
from lacuna.plans.deidentify import Config, deidentify

# Resource types of the timeline.
CLINICAL = ("Encounter", "Condition", "Observation", "Procedure", "MedicationRequest", "DiagnosticReport", "CarePlan", "AllergyIntolerance", "Immunization")
MAX_ITEMS = 30
REGIONS = ("US", "NZ", "AU")
#: Streets of address lines whose house number is longer than the rules and cues take one to be; here the label is the bundle's own field.
LONG_NUMBER = RecognizerSpec("BundleAddress", "LOCATION", rf"((?:\A|\n)(?:Address|Organization address): )(\d{{6,18}}[A-Za-z]?[ ]{NAME}(?:[ ]{NAME}){{0,3}}\b)", 0.75, "U", "second", gate=any_of("ddress: "))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(file, bundle, broken): one JSON file each. A file that is no JSON has its text in ``broken`` and no bundle."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("bundle"))
    return files.select("file", "bundle", F.when(F.col("bundle").isNull(), F.col("value")).alias("broken"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A string that is not empty, else null."""
    return F.nullif(_get(v, path), F.lit(""))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<string>"), F.array().cast("array<string>"))


def resources(bundle: Column, kind: str | None = None) -> Column:
    """Resources that are objects, in bundle order; of one type if ``kind`` is given."""
    found = F.transform(_list(bundle, "$.entry"), lambda e: _get(e, "$.resource", "variant"))
    found = F.filter(found, lambda r: r.isNotNull() & F.startswith(F.schema_of_variant(r), F.lit("OBJECT")))
    return F.filter(found, lambda r: _get(r, "$.resourceType") == kind) if kind else found


def _first_text(values: Column) -> Column:
    return F.get(F.filter(values, lambda t: t.isNotNull()), F.lit(0))


def coding_text(v: Column, path: str) -> Column:
    """``text`` of a concept, else its first coding with a display; of a list, of its first element that has one."""
    one = lambda c: F.coalesce(_text(c, "$.text"), _first_text(F.transform(_list(c, "$.coding"), lambda x: _text(x, "$.display"))))
    return F.coalesce(_first_text(F.transform(_list(v, path), one)), one(_get(v, path, "variant")))


def human_name(n: Column) -> Column:
    family = F.filter(F.array(_text(n, "$.family")), lambda x: x.isNotNull())
    return F.trim(F.array_join(F.concat(_strings(n, "$.prefix"), _strings(n, "$.given"), family), " "))


def address(a: Column) -> Column:
    rest = F.array_compact(F.array(*[_text(a, f"$.{k}") for k in ("city", "state", "postalCode", "country")]))
    return F.array_join(F.concat(_strings(a, "$.line"), rest), ", ")


def identifier_label(i: Column) -> Column:
    system = F.lower(F.coalesce(_get(i, "$.system"), F.lit("")))
    return F.coalesce(
        coding_text(i, "$.type"),
        F.when(F.contains(system, F.lit("ssn")), F.lit("Social Security Number"))
        .when(F.contains(system, F.lit("passport")), F.lit("Passport Number"))
        .when(F.contains(system, F.lit("synthea")), F.lit("FHIR patient id"))
        .otherwise(F.lit("Identifier")),
    )


#: Names that count without a semicolon, longest first.
_OLD = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
#: Names of characters, by how many buckets they are looked up in.
_NAMED, _BUCKETS = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}, 1024
#: Numbers 128 to 159 stand for what they are in Windows-1252.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


@lru_cache(maxsize=4)
def _names(app: str) -> Column:
    buckets: list[dict[str, str]] = [{"": ""} for _ in range(_BUCKETS)]
    for name, char in sorted(_NAMED.items()):
        buckets[crc32(name.encode()) % _BUCKETS][name] = char
    return F.array(*[F.create_map(*[F.lit(x) for pair in b.items() for x in pair]) for b in buckets])


def _character(code: Column) -> Column:
    """The character of a number; those that are none, 0 and surrogates are U+FFFD."""
    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    out = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    odd = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])
    return F.when(bad | code.isNull(), F.lit("\ufffd")).when(code.between(128, 159), F.coalesce(F.try_element_at(odd, code.cast("int")), F.lit(""))).otherwise(out)


def unescape(c: Column, closed: bool = False) -> Column:
    """References of HTML written out: every name that ends in a semicolon, the old ones without it, and numbers.
    With ``closed`` only those that end in a semicolon, so one that was cut off stays as it is."""
    names = _names(SparkContext.getOrCreate().applicationId)

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, rf"^(#[0-9]{{1,9}}|#[xX][0-9a-fA-F]{{1,8}}|[A-Za-z][A-Za-z0-9]{{1,31}}(?=;)|{_OLD}){'(?=;)' if closed else ''}", 1)
        rest = F.regexp_replace(F.substring(part, F.length(ref) + 1, F.length(part)), "^;", "")
        hexed = F.lower(F.left(ref, F.lit(2))) == "#x"
        code = F.when(hexed, F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 9)).cast("bigint")
        named = F.try_element_at(F.element_at(names, (F.pmod(F.crc32(ref.cast("binary")), F.lit(_BUCKETS)) + 1).cast("int")), ref)
        same = F.concat(F.lit("&"), part)
        return F.when(ref == "", same).when(F.startswith(ref, F.lit("#")), F.concat(_character(code), rest)).otherwise(F.coalesce(F.concat(named, rest), same))

    parts = F.split(c, "&", -1)
    written = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(F.contains(c, F.lit("&")), written).otherwise(c)


def strip_html(c: Column, closed: bool = False) -> Column:
    """Tags to spaces, references written out (see ``unescape``), white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]+>", " "), closed), r"(?U)\s+", " "))


def _labelled(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value))


def patient_lines(p: Column) -> Column:
    telecom = lambda t: F.when(_text(t, "$.value").isNotNull(), F.concat(F.initcap(F.coalesce(_get(t, "$.system"), F.lit("contact"))), F.lit(": "), _text(t, "$.value")))
    identifier = lambda i: F.when(_text(i, "$.value").isNotNull(), F.concat(identifier_label(i), F.lit(": "), _text(i, "$.value")))
    return F.array_compact(F.concat(
        F.transform(_list(p, "$.name"), lambda n: _labelled("Patient name", human_name(n))),
        F.array(_labelled("Birth date", _text(p, "$.birthDate")), _labelled("Gender", _text(p, "$.gender"))),
        F.transform(_list(p, "$.telecom"), telecom),
        F.transform(_list(p, "$.address"), lambda a: _labelled("Address", address(a))),
        F.transform(_list(p, "$.identifier"), identifier),
    ))


def care_team_lines(orgs: Column, practitioners: Column) -> Column:
    first = lambda v, path: F.slice(_list(v, path), 1, 1)
    of_org = lambda o: F.concat(F.array(_labelled("Organization", _text(o, "$.name"))), F.transform(first(o, "$.address"), lambda a: _labelled("Organization address", address(a))))
    of_person = lambda p: F.transform(first(p, "$.name"), lambda n: _labelled("Practitioner", human_name(n)))
    return F.array_compact(F.concat(F.flatten(F.transform(orgs, of_org)), F.flatten(F.transform(practitioners, of_person))))


def timeline_line(r: Column) -> Column:
    """The line of a clinical resource; null if it has neither a label nor a narrative."""
    reason = F.coalesce(_text(r, "$.reasonCode[0].text"), _first_text(F.transform(_list(r, "$.reasonCode[0].coding"), lambda x: _text(x, "$.display"))))
    label = F.coalesce(coding_text(r, "$.code"), coding_text(r, "$.type"), reason, F.nullif(strip_html(_text(r, "$.text.div")), F.lit("")))
    when = F.left(F.coalesce(*[_text(r, f"$.{k}") for k in ("effectiveDateTime", "authoredOn", "performedDateTime", "recordedDate", "date", "period.start")]), F.lit(10))
    return F.concat(_get(r, "$.resourceType"), F.when(when.isNotNull(), F.concat(F.lit(" on "), when)).otherwise(""), F.lit(": "), label)


def timeline_lines(all_resources: Column, most: int = MAX_ITEMS) -> Column:
    """One line for each clinical resource that has a label or a narrative; at least one if there is any."""
    clinical = F.filter(all_resources, lambda r: _get(r, "$.resourceType").isin(*CLINICAL))
    return F.slice(F.array_compact(F.transform(clinical, timeline_line)), 1, max(most, 1))


def _sections(people: Column, team: Column, clinical: Column) -> Column:
    """``people`` with its title, empty without a patient; the others get theirs if they have lines."""
    none = F.array().cast("array<string>")
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(""), F.lit(title)), lines)).otherwise(none)
    lines = F.concat(people, section("Care team and facilities", team), section("Clinical timeline", clinical))
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"^(?U)\s+|(?U)\s+$", ""), F.lit("\n"))


def bundle_text(bundle: Column, most: int = MAX_ITEMS) -> Column:
    """Demographics, care team and timeline as readable text."""
    patients = resources(bundle, "Patient")
    people = F.when(F.size(patients) > 0, F.concat(F.array(F.lit("Patient demographics")), patient_lines(F.get(patients, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    team = care_team_lines(F.slice(resources(bundle, "Organization"), 1, 3), F.slice(resources(bundle, "Practitioner"), 1, 3))
    return _sections(people, team, timeline_lines(resources(bundle), most))


def entries(bundles: DataFrame, id_col: str = "file", bundle_col: str = "bundle") -> DataFrame:
    """(id, pos, kind, resource): one row for each entry. ``resource`` is null where an entry has no object for one.

    A bundle without a list of entries (a null one too) has one row, without a place. A null id stops the job.
    """
    ident = F.when(F.col(id_col).isNull(), F.raise_error(F.lit("a bundle without an id"))).otherwise(F.col(id_col))
    known = bundles.select(ident.alias("id"), F.try_variant_get(bundle_col, "$.entry", "variant").alias("entry"))
    rows = known.lateralJoin(bundles.sparkSession.tvf.variant_explode_outer(F.col("entry").outer()))
    listed = F.col("key").isNull() & F.col("pos").isNotNull()
    found = F.when(listed, _get(F.col("value"), "$.resource", "variant"))
    rows = rows.select("id", F.when(listed, F.col("pos")).alias("pos"), found.alias("found"))
    resource = F.when(F.startswith(F.schema_of_variant("found"), F.lit("OBJECT")), F.col("found"))
    return rows.select("id", "pos", resource.alias("resource")).select("id", "pos", _get(F.col("resource"), "$.resourceType").alias("kind"), "resource")


def text_of_entries(rows: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """(id, text) of ``entries``, the text as by ``bundle_text``.

    Of each section only the first rows are kept, in each task before the shuffle already, so a
    bundle of any size sends no more than a few lines from each task. Ids have to be unique.
    """
    most = max(most, 1)
    r, kind = F.col("resource"), F.col("kind")
    none = F.array().cast("array<variant>")
    line = timeline_line(r)
    made = rows.select(
        "id", "pos",
        F.when(kind == "Patient", 1).when(kind == "Organization", 2).when(kind == "Practitioner", 3).when(kind.isin(*CLINICAL), 4).otherwise(0).alias("part"),
        F.when(kind == "Patient", patient_lines(r))
        .when(kind == "Organization", care_team_lines(F.array(r), none))
        .when(kind == "Practitioner", care_team_lines(none, F.array(r)))
        .when(kind.isin(*CLINICAL), F.array_compact(F.array(line))).alias("lines"),
    )
    # a row without a line keeps its bundle in the result
    made = made.withColumn("part", F.when((F.col("part") == 4) & (F.size("lines") == 0), 0).otherwise(F.col("part")))
    order = Window.partitionBy("id", "part").orderBy("pos")
    kept = made.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(most, 3))
    part = F.col("part")
    kept = kept.where(F.col("place") <= F.when(part.isin(2, 3), 3).when(part == 4, most).otherwise(1))
    all_of = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "lines"))).alias("kept"))
    of = lambda *parts: F.flatten(F.transform(F.filter("kept", lambda k: k["part"].isin(*parts)), lambda k: k["lines"]))
    people = F.when(F.exists("kept", lambda k: k["part"] == 1), F.concat(F.array(F.lit("Patient demographics")), of(1))).otherwise(F.array().cast("array<string>"))
    return all_of.select("id", _sections(people, of(2, 3), of(4)).alias("text"))


def deidentify_bundles(bundles: DataFrame, config: Config = Config(regions=REGIONS), most: int = MAX_ITEMS) -> DataFrame:
    """Adds text, redacted_text, spans and audit to (.., bundle)."""
    return bundles.withColumn("text", bundle_text(F.col("bundle"), most)).transform(deidentify(replace(config, extra=(*config.extra, LONG_NUMBER))))

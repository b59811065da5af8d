"""Rule recognizers: declarative specs, compiled to one array of spans for each note."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.checksums import ihi_valid, medicare_valid, nhi_valid
from lacuna.functions.domains import KNOWN
from lacuna.functions.numbering import CANDIDATE, PLANS, international, owner
from lacuna.functions.spans import filter_near, find_spans, finditer, first_of_equal_bounds, let, make_spans, no_spans, span_sql

# Word lists and label lists of the rules.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
STREET_KINDS = "Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way|Terrace|Tce|Crescent|Cres|Parade|Pde|Boulevard|Blvd|Cutting|Esplanade|Highway|Hwy"
CITY_GATE = ("address", "street", "road", "ave", "avenue", "drive", "suburb", "city", "lives", "lived")
POSTCODE_GATE = ("address", "street", "road", "ave", "avenue", "drive", "suburb", "city", "town", "postcode", "post", "nz", "australia", "auckland", "wellington", "sydney", "melbourne", "brisbane", "perth", "adelaide", "unit")
ID_LABELS = "SSN|Social Security Number|Driver'?s License|Passport(?: Number)?|Medical Record Number|FHIR patient id|FHIR resource id|Identifier"
UUID_GATE = ("mrn", "identifier", "patient id", "resource id")

#: Ends of hosts that stand for a web address without a scheme.
_ENDS = "|".join(KNOWN.last_labels())
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

_NORTH_AMERICA = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
#: Shapes of numbers by region: country or trunk prefix, then the plan's groups; free numbers as well.
PHONE_SHAPES = {
    "NZ": r"(?:(?:\+64[ -]?|\b0)(?:2[0-9]|[34679])[ -]?[0-9]{3}[ -]?[0-9]{3,4}|\b0(?:508|800|900)[ -]?[0-9]{3}[ -]?[0-9]{3,4})\b",
    "AU": r"(?:(?:\+61[ -]?|\b0)4[0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{3}|(?:\+61[ -]?|\b0|\(0)[2378]\)?[ -]?[0-9]{4}[ -]?[0-9]{4}|\b1[389]00[ -]?[0-9]{3}[ -]?[0-9]{3})\b",
    "US": _NORTH_AMERICA,
    "CA": _NORTH_AMERICA,
    "GB": r"(?:\+44[ -]?(?:\(0\)[ -]?)?|\b0|\(0)(?:[1-3][0-9]{1,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}|7[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}|80[08][ -]?[0-9]{3}[ -]?[0-9]{3,4})\b",
    "IE": r"(?:\+353[ -]?(?:\(0\)[ -]?)?|\b0|\(0)(?:8[35679]|[1-9][0-9]?)\)?[ -]?[0-9]{3}[ -]?[0-9]{3,4}\b",
}
REGIONS = frozenset(PLANS)


@dataclass(frozen=True)
class RecognizerSpec:
    """A pattern with what is kept of its matches.

    ``part``: "whole" match, or the "second" or "first" of two groups side by side. ``valid`` takes the
    span's text; ``near`` (characters before, characters behind, words) asks for one of the words around the match. ``gate`` is a cheap test that every note
    with a match passes: word boundaries and case-blind classes cost far more than a plain search, and
    most notes lack what a pattern needs. ``first`` is what every match begins with, in the pattern's flags: looking
    for it costs less than the word boundary that would be judged at each character else.
    """

    name: str
    kind: str
    pattern: str
    score: float
    flags: str = "U"
    part: str = "whole"
    valid: Callable[[Column], Column] | None = None
    near: tuple[int, int, tuple[str, ...]] | None = None
    gate: Callable[[Column], Column] | None = None
    first: str | None = None

    def spans(self, text: Column, source: str = "rule") -> Column:
        pattern = f"(?={self.first}){self.pattern}" if self.first else self.pattern
        span = span_sql(self.kind, self.score, self.name, source)
        if self.near:
            before, after, words = self.near
            said = lambda h, local, base: _any_word(words)(_window(local, h["start"] - before - base, h["end"] + after - base))
            hits = let(finditer(text, pattern, self.flags, self.part != "whole"), lambda found: filter_near(text, found, said, before, after))
            start, end, part = {"whole": ("start", "end", "tail"), "second": ("mid", "end", "tail"), "first": ("start", "mid", "head")}[self.part]
            spans = make_spans(hits, f"h.{start}", f"h.{end}", f"h.{part}", span)
        else:
            spans = find_spans(text, pattern, self.flags, self.part, span)
        if self.valid:
            spans = F.filter(spans, lambda s: self.valid(s["text"]))
        return F.when(self.gate(text), spans).otherwise(no_spans()) if self.gate else spans


#: A word's bound where only ASCII has letters and digits, as RE2 and so the SQL of other engines has it.
_ASCII_WORD = "(?-iU:[0-9A-Za-z_])"
_ASCII_BOUND = rf"(?:(?<!{_ASCII_WORD})(?={_ASCII_WORD})|(?<={_ASCII_WORD})(?!{_ASCII_WORD}))"


def bounded_by_ascii(spec: RecognizerSpec) -> RecognizerSpec:
    """The recognizer with word boundaries that know ASCII only: letters beyond it stand outside of words."""
    return replace(spec, pattern=spec.pattern.replace(r"\b", _ASCII_BOUND))


def has(regex: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_like(text, F.lit(regex))


def _any_word(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """One search for all of the words."""
    return has(f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(re.escape(w) for w in words)})")


def any_of(*words: str, lower: bool = False) -> Callable[[Column], Column]:
    """Whether the text, or the text in lower case, contains one of the words."""
    if len(words) > 3:  # one search for all is faster than one for each
        said = _any_word(words)
    else:
        said = lambda text: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    return (lambda text: let(F.lower(text), said)) if lower else said


def _date_valid(c: Column) -> Column:
    """A day of the calendar; two-digit years are of this century, years of one or three digits are none."""
    iso = F.regexp_like(c, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    slash = F.split(c, "/")
    year = F.element_at(slash, -1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    two = lambda x: F.lpad(x, 2, "0")
    by_slash = F.concat_ws("-", full, two(F.get(slash, F.lit(1))), two(F.get(slash, F.lit(0))))
    words = F.split(F.lower(c), r"\s+")
    month = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.left(F.get(words, F.lit(1)), F.lit(3))).cast("string")
    by_name = F.concat_ws("-", F.get(words, F.lit(2)), two(month), two(F.get(words, F.lit(0))))
    text = F.when(iso, c).when(F.contains(c, F.lit("/")), F.when(full.isNotNull(), by_slash)).otherwise(by_name)
    return F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def _window(text: Column, start: Column, end: Column) -> Column:
    lo = F.greatest(start, F.lit(0))
    return F.lower(F.substring(text, lo + 1, end - lo))


def _ip_valid(c: Column) -> Column:
    """Octets up to 255, those behind a colon as well; of an address with colons eight groups at most, and a digit."""
    octets = F.forall(F.split(F.substring_index(c, ":", -1), r"\."), lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))
    v6 = F.regexp_like(c, F.lit("[0-9]")) & (F.size(F.split(c, ":")) <= 8)
    return F.when(~F.contains(c, F.lit(".")), v6).otherwise(octets)


NHI_OLD = RecognizerSpec("NhiOldRecognizer", "NHI", r"\b[A-HJ-NP-Z]{3}\d{4}\b", 1.0, "iU", valid=nhi_valid, gate=has(r"\p{Nd}{4}"))
NHI_NEW = RecognizerSpec("NhiNewRecognizer", "NHI", r"\b[A-HJ-NP-Z]{3}\d{2}[A-HJ-NP-Z]{2}\b", 0.6, "iU", gate=has(r"\p{Nd}{2}"))
MEDICARE = RecognizerSpec("MedicareRecognizer", "MEDICARE", r"\b[2-6]\d{7}\s?\d\s?\d?\b", 1.0, valid=medicare_valid, gate=has(r"\p{Nd}{8}"), first=r"[2-6]")
IHI = RecognizerSpec("IhiRecognizer", "IHI", r"\b8003\s?60\s?\d{4}\s?\d{4}\s?\d{2}\b", 1.0, valid=ihi_valid, gate=any_of("8003"), first=r"8")
PHONE_LABELLED = RecognizerSpec("PhoneRecognizerPhi", "PHONE", r"(\b(?:Phone|Telephone|Contact|Mobile)[:\s]+)([+()0-9][0-9 .()/-]{6,}\b)", 0.75, "iU", "second", gate=has("[+()0-9][0-9 .()/-]{6}"))
DATE = RecognizerSpec("DateRecognizerCustom", "DATE", rf"(?:\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\b\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b)", 0.85, "iU", valid=_date_valid, gate=has(r"\p{Nd}"), first=r"\d")
MRN = RecognizerSpec("MrnRecognizer", "MRN", r"(\b(?:MRN|UR|U/R)[:\s#]*)(\d{5,8}\b)", 0.85, "iU", "second", gate=has(r"\p{Nd}{5}"))
ID_LABELLED = RecognizerSpec("GenericIdRecognizer", "ID", rf"(\b(?:{ID_LABELS})[:\s#]+)([A-Z0-9][A-Z0-9-]{{5,}}\b)", 0.8, "iU", "second", gate=any_of("ssn", "security number", "license", "passport", "record number", "patient id", "resource id", "identifier", lower=True))
SSN = RecognizerSpec("GenericIdRecognizer", "ID", r"\b\d{3}-\d{2}-\d{4}\b", 0.85, gate=has(r"\p{Nd}{3}-\p{Nd}"), first=r"\d")
UUID = RecognizerSpec("GenericIdRecognizer", "ID", rf"\b{_UUID}\b", 0.75, "iU", near=(40, 20, UUID_GATE), gate=has("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), first=r"[0-9a-f]{8}-")
AGE_SHORT = RecognizerSpec("AgeRecognizer", "AGE", r"\b\d{1,3}\s*(?:yo|y/o)\b", 0.75, "iU", gate=has(r"\p{Nd}(?U)\s*[yY]"), first=r"\d")
AGE_LONG = RecognizerSpec("AgeRecognizer", "AGE", r"\b\d{1,3}\s*years?\s*old\b", 0.75, "iU", gate=has(r"\p{Nd}(?U)\s*[yY]"), first=r"\d")
#: An address of four octets; a street's pattern takes it as well, so its last number begins no street. The address is dropped again.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
STREET = RecognizerSpec("LocationRecognizer", "LOCATION", rf"(?:\b(?:{_OCTET}\.){{3}}{_OCTET}\b|\b\d{{1,5}}\s+[A-Za-z]+(?:[\s\-'][A-Za-z]+){{0,64}}\s+(?:{STREET_KINDS})\b)", 0.75, "iU", valid=lambda c: ~F.contains(c, F.lit(".")), gate=has(r"\p{Nd}(?U)\s"), first=r"\d")
CITY = RecognizerSpec("LocationRecognizer", "LOCATION", r"(\b[A-Za-z]++(?:\s++[A-Za-z]++)?+)(\s*,?\s+\d{4}\b)", 0.6, "iU", "first", near=(50, 10, CITY_GATE), gate=has(r"(?U)\s\p{Nd}{4}"), first="[A-Za-z]")
EMAIL = RecognizerSpec("EmailRecognizer", "EMAIL", r"\b[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.){1,127}[A-Za-z]{2,63}\b", 1.0, "iU", valid=lambda c: KNOWN.registered(F.substring_index(c, "@", -1)), gate=any_of("@"))
URL = RecognizerSpec("UrlRecognizer", "URL", rf"(?:\bhttps?://[^\s<>\"']+|\b(?:[a-z0-9-]+\.){{1,127}}(?:{_ENDS})\b(?:/[^\s<>\"']*)?)", 0.6, "iU", valid=lambda c: F.contains(c, F.lit("://")) | KNOWN.web_address(F.substring_index(c, "/", 1)), gate=has(rf"://|[.](?i:{_ENDS})"))
IP = RecognizerSpec("IpRecognizer", "IP", r"(?:(?:\b(?:0{1,4}:){1,5}|\B::)ffff:(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6}\b|\B::(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4}\b)", 0.6, "iU", valid=_ip_valid, gate=has(r"\p{Nd}[.]\p{Nd}|:[0-9a-fA-F]{0,4}:"), first=r"[\da-f:]")


PLANNED = RecognizerSpec("PhoneRecognizerPhi", "PHONE", CANDIDATE, 0.9, gate=has("[0-9]{2}"))


def phone_region(region: str) -> RecognizerSpec:
    """Numbers as a region writes them: its shapes where some are known, else runs of digits that its numbering plan has."""
    if region not in REGIONS:
        raise ValueError(f"no phone numbers are known for region {region}")
    if region in PHONE_SHAPES:
        return RecognizerSpec("PhoneRecognizerPhi", "PHONE", PHONE_SHAPES[region], 0.9, gate=has("[0-9]{2}"), first="[0-9+(]")
    return replace(PLANNED, valid=lambda c: owner(international(c, region)).isNotNull())


def phones(text: Column, regions: tuple[str, ...]) -> Column:
    """Labelled numbers, then each region's. Bounds seen before are not looked at again, not even if that number was
    of a region not asked for: a number that one region's plan gives to another counts only if that one is asked for too.
    """
    of = lambda c, r: owner(international(c, r))

    def found(region: str) -> Column:
        spans = phone_region(region).spans(text)
        if region in PHONE_SHAPES and region not in ("US", "CA"):  # shapes of a code of its own
            return spans
        return F.transform(spans, lambda s: s.withField("seq", F.when(of(s["text"], region).isin(*regions), 0).otherwise(1)))

    seen = first_of_equal_bounds(PHONE_LABELLED.spans(text), *[found(r) for r in regions])
    if all(r in PHONE_SHAPES and r not in ("US", "CA") for r in regions):
        return seen
    return F.filter(seen, lambda s: s["seq"] == 0)


def generic_ids(text: Column) -> Column:
    return first_of_equal_bounds(*[spec.spans(text) for spec in (ID_LABELLED, SSN, UUID)])


def locations(text: Column, ascii_words: bool = False) -> Column:
    street = bounded_by_ascii(STREET) if ascii_words else STREET
    return first_of_equal_bounds(street.spans(text), CITY.spans(text))


def postcodes(text: Column) -> Column:
    """Numbers of 4 or 5 digits on lines that have an address word as a whole word."""
    # two letters that a word begins with are seen faster than its boundary; classes that are blind to case know U+017F for s as well
    gate = rf"(?iU:(?=[{''.join(sorted({w[0] for w in POSTCODE_GATE}))}][{''.join(sorted({w[1] for w in POSTCODE_GATE}))}])\b(?:{'|'.join(POSTCODE_GATE)})\b)"
    number = r"(?=\d)\b\d{4,5}(?:-\d{4})?\b"
    # the full stop knows all ends of lines but these, which become line feeds: a class of characters that are none took most of the time of a whole plan
    ends = "\x0b\x0c\x1c\x1d\x1e"
    lined = F.when(has(f"[{ends}]")(text), F.translate(text, ends, "\n" * len(ends))).otherwise(text)
    # a search begins at each line's beginning and nowhere else, and passes over lines without a number
    lines = finditer(lined, rf"(?<!.)(?=.*\p{{Nd}}{{4}}).*?{gate}.*", "U")
    moved = lambda s, by: s.withField("start", s["start"] + by).withField("end", s["end"] + by)
    within = lambda line: F.transform(find_spans(line["tail"], number, "U", "whole", span_sql("POSTCODE", 0.7, "PostcodeRecognizer")), lambda s: moved(s, line["start"]))
    found = F.flatten(F.transform(lines, within))
    return F.when(has(r"\p{Nd}{4}")(text) & F.regexp_like(text, F.lit(gate)), found).otherwise(no_spans())


def rule_spans(text: Column, regions: tuple[str, ...] = ("NZ", "AU"), extra: tuple[RecognizerSpec, ...] = (), ascii_words: bool = False) -> Column:
    """All rule spans of a note in registry order; ``extra`` recognizers come last. With ``ascii_words`` streets, mail and IP addresses have the word boundaries of ASCII."""
    email, ip = map(bounded_by_ascii, (EMAIL, IP)) if ascii_words else (EMAIL, IP)
    simple = lambda *specs: [s.spans(text) for s in specs]
    parts = [
        *simple(NHI_OLD, NHI_NEW, MEDICARE, IHI),
        phones(text, tuple(regions)),
        *simple(DATE, MRN),
        generic_ids(text),
        *simple(AGE_SHORT, AGE_LONG),
        locations(text, ascii_words),
        postcodes(text),
        *simple(email, URL, ip, *extra),
    ]
    return F.concat(*parts)

"""Entity layer: native cues and gazetteer by default, any model through a pandas hook."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import SPANS, no_spans
from lacuna.operators.recognizers import RecognizerSpec, any_of, locations

# Texts that are never organisations.
NOISY_ORGS = ("nhi", "ihi", "medicare", "mrn", "ur", "u/r", "dob", "phone", "email", "fax", "address", "postcode", "patient", "clinic", "hospital", "social security number", "driver's license", "passport number", "medical record number", "nhis")

_NAME = r"(?:\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?|\p{Lu}\.)"
_FULL = rf"{_NAME}(?:[ ]{_NAME}){{1,3}}"
CITIES = "Auckland|Wellington|Christchurch|Hamilton|Tauranga|Dunedin|Napier|Sydney|Melbourne|Brisbane|Perth|Adelaide|Hobart|Darwin|Canberra|Queenstown|Rotorua|Nelson"

#: Cues before a name; names themselves keep their case.
CUES = (
    RecognizerSpec("cue:label", "PERSON", rf"(\b(?i:Patient name|Patient|Name|Practitioner|Next of kin)[: ][ ]*)({_FULL})", 0.85, "U", "second", gate=any_of("patient", "name", "practitioner", "next of kin", lower=True)),
    RecognizerSpec("cue:title", "PERSON", rf"(\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? )({_NAME}(?: {_NAME}){{0,2}})", 0.85, "U", "second", gate=any_of("Mr", "Ms ", "Ms. ", "Miss ", "Dr", "Prof")),
    RecognizerSpec("cue:kin", "PERSON", rf"(\b(?i:Daughter|Son|Wife|Husband|Mother|Father|Sister|Brother|Partner|Carer) )({_FULL})", 0.85, "U", "second", gate=any_of("daughter ", "son ", "wife ", "husband ", "mother ", "father ", "sister ", "brother ", "partner ", "carer ", lower=True)),
    RecognizerSpec("cue:place", "LOCATION", rf"\b(?:{CITIES})\b", 0.6, gate=any_of(*CITIES.split("|"))),
    RecognizerSpec("cue:address", "LOCATION", rf"(\b(?i:Address|Lives at|Lived at)[: ]+)(\d{{1,5}}[A-Za-z]?[ ]{_NAME}(?:[ ]{_NAME}){{0,3}}\b)", 0.6, "U", "second", gate=any_of("address", "lives at", "lived at", lower=True)),
    RecognizerSpec("cue:care", "ORG", rf"{_NAME}(?: {_NAME}){{0,3}} (?:Hospital|Clinic|Medical Centre|Health Centre)\b", 0.6, gate=any_of("Hospital", "Clinic", "Medical Centre", "Health Centre")),
)


def noisy(s: Column) -> Column:
    """Names with digits, organisations that are labels, and anything over a line break."""
    text = F.trim(s["text"])
    digits = (s["type"] == "PERSON") & F.regexp_like(text, F.lit(r"(?U)\d"))
    label = (s["type"] == "ORG") & F.lower(text).isin(*NOISY_ORGS)
    return digits | label | F.contains(s["text"], F.lit("\n")) & F.contains(F.regexp_replace(s["text"], r"^(?U)\s+|(?U)\s+$", ""), F.lit("\n"))


def cue_spans(text: Column, threshold: float = 0.40, with_rules: bool = True) -> Column:
    """Spans of the native entity layer; without the rule layer its locations come from here too."""
    own = lambda spans: F.transform(spans, lambda s: s.withField("source", F.lit("ner")))
    found = F.concat(*[spec.spans(text, "ner") for spec in CUES], *([] if with_rules else [own(locations(text))]))
    return F.filter(found, lambda s: (s["score"] >= threshold) & ~noisy(s))


#: Models that a worker keeps, the latest used last, by their keys; and how many.
_engines: OrderedDict[Hashable, Callable] = OrderedDict()
ENGINES = 4


def engine(key: Hashable, load: Callable[[], Callable]) -> Callable:
    """The worker's model of that key, loaded where it has none; beyond ``ENGINES`` the one not used for longest goes."""
    if key not in _engines:
        _engines[key] = load()
        while len(_engines) > ENGINES:
            _engines.popitem(last=False)
    _engines.move_to_end(key)
    return _engines[key]


def model_spans(notes: DataFrame, detect: Callable[[list[str]], list[list[dict]]] | None = None, column: str = "ner_spans", text_col: str = "text", threshold: float = 0.40, load: Callable[[], Callable] | None = None, key: Hashable = None) -> DataFrame:
    """Add the spans of a model: ``detect`` takes a list of texts and gives lists of {start, end, type, score}.

    Arrow batches. A model that is costly to make is given as ``load``, which returns such a ``detect``: each worker calls it once
    for a ``key`` (the regions and settings that the model depends on) and keeps it for its later tasks and queries.
    """
    if (detect is None) == (load is None):
        raise ValueError("either detect or load has to be given")

    @F.pandas_udf(SPANS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = detect or engine(key, load)
        full = lambda t, s: {"start": s["start"], "end": s["end"], "type": s["type"], "text": t[s["start"] : s["end"]], "score": float(s.get("score", 1.0)), "source": "ner", "recognizer": s.get("recognizer", "model"), "seq": 0}
        for texts in batches:
            clean = texts.fillna("").tolist()
            yield pd.Series([[full(t, s) for s in spans] for t, spans in zip(clean, find(clean), strict=True)])

    kept = F.filter(of(F.col(text_col)), lambda s: (s["score"] >= threshold) & ~noisy(s))
    return notes.withColumn(column, F.coalesce(kept, no_spans()))

"""The main plan: detect, redact, count. Row-local columns, no shuffle; the same on batch and stream."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import no_spans, settled
from lacuna.operators.assist import with_assistant
from lacuna.operators.merge import disjoint, filter_redacted, layers, merge_spans
from lacuna.operators.ner import cue_spans
from lacuna.operators.recognizers import REGIONS, RecognizerSpec, rule_spans
from lacuna.operators.redact import STRATEGIES, audit, redact, replacements


@dataclass(frozen=True)
class Config:
    strategy: str = "mask"
    use_rules: bool = True
    use_ner: bool = True
    ner_threshold: float = 0.40
    regions: tuple[str, ...] = ("NZ", "AU")
    key: str | None = field(default=None, repr=False)
    #: Native HMAC shows the key in plans; False keeps it in a Python closure.
    native_key: bool = False
    #: A language model's second pass: (text, spans, regions) -> [{text, type}].
    assistant: Callable | None = None
    extra: tuple[RecognizerSpec, ...] = ()
    #: Streets, mail and IP addresses end where ASCII's words do, as in SQL engines with RE2: beside letters beyond ASCII as well.
    ascii_words: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no such strategy: {self.strategy}")
        if self.strategy != "mask" and not self.key:
            raise ValueError(f"{self.strategy} needs a key")
        if not 0 <= self.ner_threshold <= 1:
            raise ValueError("the threshold of the entity layer lies between 0 and 1")
        if unknown := sorted(set(self.regions) - REGIONS):
            raise ValueError(f"no phone numbers are known for regions {', '.join(unknown)}")

    @classmethod
    def from_env(cls, env_file: str = ".env", **given) -> "Config":
        """PHI_HASH_KEY, PHI_REGIONS and PHI_NER_THRESHOLD, from the environment or else from ``env_file``; arguments go before both."""
        found = settings(env_file)
        known = {"key": found.get("PHI_HASH_KEY")}
        if regions := [r.strip().upper() for r in found.get("PHI_REGIONS", "").split(",") if r.strip()]:
            known["regions"] = tuple(regions)
        if threshold := found.get("PHI_NER_THRESHOLD"):
            known["ner_threshold"] = float(threshold)
        return cls(**known | given)


def settings(env_file: str = ".env") -> dict[str, str]:
    """Variables of a file of NAME=value lines, under those of the environment."""
    found = {}
    if os.path.isfile(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                name, sign, value = line.strip().removeprefix("export ").partition("=")
                if sign and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("'\"")
    return found | dict(os.environ)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


# Columns are trees of thousands of nodes, each made by a call to the JVM: made once for each application.


@lru_cache(maxsize=32)
def _rules(app: str, text_col: str, regions: tuple[str, ...], extra: tuple[RecognizerSpec, ...], ascii_words: bool) -> Column:
    return rule_spans(_text(text_col), regions, extra, ascii_words)


@lru_cache(maxsize=32)
def _cues(app: str, text_col: str, threshold: float, with_rules: bool) -> Column:
    return cue_spans(_text(text_col), threshold, with_rules)


@lru_cache(maxsize=32)
def _settling(app: str, text_col: str, spans_col: str) -> tuple[Column, Column, Column]:
    """The filter of redacted tokens, the merge after it, and the check of its result."""
    text = _text(text_col)
    return filter_redacted(text, layers(F.col(spans_col))), merge_spans(text, F.col(spans_col)), disjoint(F.col(spans_col))


def detect(notes: DataFrame, config: Config = Config(), text_col: str = "text", spans_col: str = "spans", ner_col: str | None = None) -> DataFrame:
    """Add sorted, disjoint spans. ``ner_col`` names spans of a model that take the place of the cues.

    A null text has no spans.
    """
    app = SparkContext.getOrCreate().applicationId
    parts = []
    if config.use_rules:
        parts.append(_rules(app, text_col, tuple(config.regions), tuple(config.extra), config.ascii_words))
    if config.use_ner:
        parts.append(F.col(ner_col) if ner_col else _cues(app, text_col, config.ner_threshold, config.use_rules))
    out = settled(notes, spans_col, F.concat(*parts) if parts else no_spans())
    if config.assistant:
        out = with_assistant(out, config.assistant, config.regions, text_col, spans_col)
    kept, merged, checked = _settling(app, text_col, spans_col)
    return settled(settled(out, spans_col, kept), spans_col, merged).withColumn(spans_col, checked)


def deidentify(config: Config = Config(), text_col: str = "text", **kw) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``: adds ``redacted_text``, ``spans`` (offsets in the original) and ``audit``."""

    def run(notes: DataFrame) -> DataFrame:
        found = detect(notes, config, text_col, "spans", **kw)
        found = settled(found, "lacuna_strings", replacements(F.col("spans"), config.strategy, config.key, config.native_key))
        return found.select(*notes.columns, redact(F.col(text_col), F.col("spans"), F.col("lacuna_strings")).alias("redacted_text"), "spans", audit(F.col("spans")).alias("audit"))

    return run


def corpus_audit(found: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Counts by type over all notes."""
    return found.select(F.explode(spans_col).alias("s")).groupBy(F.col("s.type").alias("type")).count()

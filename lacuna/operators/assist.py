"""Optional second pass by a language model, handed in as a callable; off by default.

The callable takes (text, spans found so far, regions) and gives [{text, type}] or None. Whatever it
raises counts as nothing found.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import SPANS
from lacuna.operators.merge import PRIORITY

# Which environment variable holds the key of a provider's models, by the provider's names and by how its models' bare names
# begin. The callable reads the variable, nothing is set.
PROVIDER_KEYS = {
    **{p: f"{p.upper()}_API_KEY" for p in ("openai", "anthropic", "azure", "gemini", "mistral", "groq", "cohere", "together", "deepseek", "openrouter", "xai")},
    "azure_ai": "AZURE_API_KEY",
    "google": "GEMINI_API_KEY",
    "together_ai": "TOGETHER_API_KEY",
}
BARE_NAMES = {"claude-": "ANTHROPIC_API_KEY", "gpt-": "OPENAI_API_KEY", "o1": "OPENAI_API_KEY", "o3": "OPENAI_API_KEY", "o4": "OPENAI_API_KEY"}
SYSTEM = 'You find protected health information in clinical notes that earlier passes have missed. Answer with one JSON object: {"spans": [{"text": exact text from the note, "type": one of the types}]}. Leave out what is already listed. Types: ' + ", ".join(sorted(PRIORITY))
SCORE = 0.75


def key_variable(model: str) -> str | None:
    """The variable for ``provider/model`` or a bare model name; None for providers that need none."""
    provider, slash, _ = model.lower().partition("/")
    if slash:
        return PROVIDER_KEYS.get(provider)
    return next((v for start, v in BARE_NAMES.items() if provider.startswith(start)), None)


def prompt(text: str, known: list[dict], regions: tuple[str, ...]) -> list[dict]:
    """Messages with the note, what is found already, and the regions."""
    listed = "\n".join(f"* {s['type']}: {s['text']!r}" for s in known) or "* nothing"
    user = f"Regions: {', '.join(regions)}\n\nFound so far:\n{listed}\n\nNote:\n{text}"
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": user}]


def parsed(answer: str | None) -> list[dict]:
    """The spans of a JSON answer that have a text and a type."""
    spans = json.loads(answer or "{}").get("spans") or []
    return [s for s in spans if isinstance(s, dict) and isinstance(s.get("text"), str) and s["text"] and isinstance(s.get("type"), str)]


def completing(*backends: Callable[[list[dict]], str]) -> Callable:
    """An assistant that asks backends (messages -> answer) one after the other until one answers; none: nothing found."""
    def ask(text: str, known: list[dict], regions: tuple[str, ...]) -> list[dict]:
        messages = prompt(text, known, regions)
        for backend in backends:
            try:
                return parsed(backend(messages))
            except Exception as e:  # noqa: BLE001  the next backend may do better
                logging.getLogger(__name__).warning("a backend failed: %s", e)
        return []

    return ask


def litellm_backend(model: str, key: str | None = None) -> Callable[[list[dict]], str]:
    """Calls ``model`` through the litellm package, which has to be installed where tasks run; without ``key`` it reads ``key_variable(model)`` itself."""
    def complete(messages: list[dict]) -> str:
        import litellm

        given = {"api_key": key} if key else {}
        return litellm.completion(model=model, messages=messages, temperature=0.0, response_format={"type": "json_object"}, **given)["choices"][0]["message"]["content"]

    return complete


def resolve(text: str, part: str, taken: list[tuple[int, int]]) -> tuple[int, int] | None:
    """First place of ``part`` that overlaps nothing taken; a taken place is left at its end."""
    at = text.find(part)
    while at >= 0:
        end = at + len(part)
        if all(end <= a or b <= at for a, b in taken):
            return at, end
        at = text.find(part, end)
    return None


def place_answers(text: str, known: list[dict], answers: list[dict] | None, name: str) -> list[dict]:
    """Spans of the answers; a type that is not known is skipped after its place is taken."""
    taken = [(s["start"], s["end"]) for s in known]
    out = []
    for a in answers or []:
        place = resolve(text, a["text"], taken) if a.get("text") else None
        if place is None:
            continue
        taken.append(place)
        kind = str(a.get("type", "")).upper()
        if kind in PRIORITY:
            out.append({"start": place[0], "end": place[1], "type": kind, "text": text[place[0] : place[1]], "score": SCORE, "source": "llm", "recognizer": name, "seq": 0})
    return out


def assisted_spans(ask: Callable, regions: tuple[str, ...], name: str = "assistant") -> Callable[[Column, Column], Column]:
    """A function (text, spans so far) -> spans, in Arrow batches."""
    def one(text: str, known: list[dict]) -> list[dict]:
        try:
            return place_answers(text, known, ask(text, known, regions), name)
        except Exception as e:  # noqa: BLE001  a failed call leaves the note to the other layers
            logging.getLogger(__name__).warning("second pass failed: %s", e)
            return []

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([one(t or "", [dict(s) for s in known]) for t, known in zip(texts, spans, strict=True)])

    return of


def with_assistant(notes: DataFrame, ask: Callable, regions: tuple[str, ...], text_col: str = "text", spans_col: str = "spans", name: str = "assistant") -> DataFrame:
    return notes.withColumn(spans_col, F.concat(F.col(spans_col), assisted_spans(ask, regions, name)(F.col(text_col), F.col(spans_col))))

"""Command line: redact one note or one bundle, or score a labelled corpus."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lacuna import ship
from lacuna.operators import assist, evaluate
from lacuna.plans.deidentify import Config, deidentify, detect, settings
from lacuna.sources import fhir, notes


# Fixed value: the model where LLM_MODEL is not set.
MODEL = "anthropic/claude-haiku-4-5"


def _print(row) -> None:
    print(notes.note_report(row["redacted_text"], [(a["type"], a["count"]) for a in row["audit"]]))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lacuna", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("note", "bundle"):
        one = sub.add_parser(name)
        one.add_argument("file")
        one.add_argument("--strategy", choices=("mask", "hash", "surrogate"), default="mask")
        one.add_argument("--no-ner", action="store_true")
        one.add_argument("--llm", action="store_true", help="second pass by LLM_MODEL")
        if name == "bundle":
            one.add_argument("--extract-only", action="store_true")
            one.add_argument("--max-clinical-items", type=int, default=fhir.MAX_ITEMS)
    score = sub.add_parser("score")
    score.add_argument("root")
    score.add_argument("--out", help="write the Markdown report here")
    args = p.parse_args(argv)
    spark = ship(SparkSession.builder.appName("lacuna").getOrCreate())
    if args.command == "score":
        scored = evaluate.score_notes(detect(notes.read_corpus(spark, args.root))).cache()
        text = evaluate.report(scored)
        print(text)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        return 0 if evaluate.passes_gate(scored) else 1
    given = {"regions": fhir.REGIONS} if args.command == "bundle" else {}
    if args.llm:
        found = settings()
        given["assistant"] = assist.completing(assist.litellm_backend(found.get("LLM_MODEL", MODEL), found.get("API_KEY")))
    config = Config.from_env(strategy=args.strategy, use_ner=not args.no_ner, **given)
    if args.command == "note":
        _print(notes.read_notes(spark, args.file).transform(deidentify(config)).first())
        return 0
    bundles = fhir.read_bundles(spark, args.file)
    if args.extract_only:
        print(bundles.select(fhir.bundle_text(bundles.bundle, args.max_clinical_items)).first()[0], end="")
        return 0
    _print(fhir.deidentify_bundles(bundles, config, args.max_clinical_items).first())
    return 0


if __name__ == "__main__":
    sys.exit(main())

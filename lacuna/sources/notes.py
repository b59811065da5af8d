"""Notes: text files, a labelled corpus, generated notes, and the text sink of one note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "version string, notes array<struct<id:string, file:string, spans:array<struct<start:int, end:int, type:string, text:string>>>>"


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row for each UTF-8 file, line ends as one newline."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), newlines(F.col("value")).alias("text"))


def check_offsets(text: Column, spans: Column) -> Column:
    """The spans, or an error where the text between a span's offsets is not the span's."""
    drift = F.exists(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["text"])
    return F.when(drift, F.raise_error(F.lit("offset drift between labels and text"))).otherwise(spans)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, text, gold): ``labels.json`` joined with the files that it names, offsets checked."""
    labels = spark.read.schema(LABELS).json(f"{root}/labels.json", multiLine=True).select(F.explode("notes").alias("n"))
    labels = labels.select(F.col("n.id").alias("note_id"), F.element_at(F.split("n.file", "/"), -1).alias("name"), F.col("n.spans").alias("spans"))
    files = read_notes(spark, f"{root}/notes").withColumn("name", F.element_at(F.split("file", "/"), -1))
    # the planner broadcasts the labels if they are small and sorts both sides if not
    both = files.join(labels, "name").select("note_id", "text", check_offsets(F.col("text"), F.col("spans")).alias("s"))
    gold = F.transform("s", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"), F.lit(1.0).alias("score"), F.lit("gold").alias("source"), F.lit(None).cast("string").alias("recognizer"), i.alias("seq")))
    return both.select("note_id", "text", gold.alias("gold"))


def render_segments(segments: Column) -> Column:
    """``array<struct<text,label>>`` -> struct(text, spans): texts joined, offsets of the labelled ones."""
    zero = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int,type:string,text:string>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        at = F.length(acc["text"])
        span = F.struct(at.alias("start"), (at + F.length(s["text"])).alias("end"), s["label"].alias("type"), s["text"].alias("text"))
        return F.struct(F.concat(acc["text"], s["text"]).alias("text"), F.when(s["label"].isNotNull(), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, zero, step)


def note_report(redacted: str, counts: list[tuple[str, int]]) -> str:
    """One note for a terminal: the text, then the counts if there are any."""
    lines = [redacted]
    if counts:
        lines += ["", "--- Audit ---", *(f"{k}: {n}" for k, n in counts)]
    return "\n".join(lines)

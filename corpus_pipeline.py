"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs as Parquet wrote it, and works on all of its rows:

1. quality: documents that the compression classifier rejects go (score under 0.5).
2. near_duplicates: of each component of the 5-gram Jaccard join the smallest doc_id stays.
3. repeated_passages: words under windows of 20 words that stand earlier are cut out of their texts; a
   text that loses nothing stays as it is, and a text that loses all words stays as an empty one.
4. decontamination: documents with a benchmark passage go.
5. packing: pieces of token ids in sequences of 2048.

Stages 1 to 4 return the columns of ``documents``. Rows with a null doc_id pass stages 2 to 4
unchanged and are left out by stage 5, with their tokens; null texts count as empty; repeated rows are each kept or dropped; an empty table gives an
empty result. SQL can't express compression or SimHash, so tests hold the stages against plain
Python versions.
"""

from __future__ import annotations

from lacuna import ship
from lacuna.llm import decontam, fm_dedup, ngram_join, packing, quality_zstd
from lacuna.llm.queries import tokenizer_file
from lacuna.llm.wordblock import keep


def quality(spark, docs, sf_dir):
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_zstd.keep_good(docs, labels)


def near_duplicates(spark, docs, sf_dir):
    ship(spark)
    copies = ngram_join.similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark, docs, sf_dir):
    ship(spark)
    return fm_dedup.rewrite(docs)


def decontamination(spark, docs, sf_dir):
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    tainted = keep(decontam.passages(docs, benchmark).select("doc_id").distinct(), "tainted")
    return docs.join(tainted, "doc_id", "left_anti").select(docs.columns)


def pack(spark, docs, sf_dir):
    return packing.pack(docs, tokenizer_file(ship(spark)))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order, each result written to the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs

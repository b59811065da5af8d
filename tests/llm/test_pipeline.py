"""Stages of the pipeline on one small corpus, each against a plain version on its own input."""

from collections import defaultdict

import corpus_pipeline as pipeline
from lacuna.llm import decontam, quality_zstd
from tests.llm.texts import corpus, similar, stripped


def test_stages(spark, tmp_path):
    rows = corpus(n=120)
    items = [(k, " ".join((dict(rows)[d] or "").split()[3:30])) for k, d in enumerate((6, 7, 8, 15))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "s", len(t or "")) for i, t in [*rows, (None, "no id but words enough to stay")]]
    spark.createDataFrame(full, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, int(i % 9 != 4), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    state = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, state[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        state.append(spark.read.parquet(str(tmp_path / name)))
        if name != "packing":
            assert state[-1].columns == docs.columns
    start, good, one, cut, clean, packed = [[(r.doc_id, r.text) if "text" in r else r for r in s.collect()] for s in state]

    scores = {r.doc_id: r.predicted for r in quality_zstd.score(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    assert sorted(i for i, _ in good if i is not None) == sorted(i for i, p in scores.items() if p)
    have = [(i, t) for i, t in good if i is not None]
    assert sorted(i for i, _ in one if i is not None) == sorted(i for i, (_, c) in similar(have).items() if c == i)
    have = [(i, t) for i, t in one if i is not None]
    want = {i: " ".join(kept) if len(kept) < n else (dict(have)[i] or "") for i, (n, kept) in stripped(have).items()}
    assert {i: t for i, t in cut if i is not None} == want
    hit = {r.doc_id for r in decontam.passages(state[3], spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()}
    assert hit and sorted(i for i, _ in clean if i is not None) == sorted(i for i, _ in cut if i is not None and i not in hit)
    total = defaultdict(int)
    for r in packed:
        total[r.doc_id] += r.length
    assert set(total) == {i for i, _ in clean if i is not None}
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)

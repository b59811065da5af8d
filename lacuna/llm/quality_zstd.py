"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from good texts and one from bad ones. A text is compressed in pieces of
``PIECE`` bytes with each, so that a dictionary counts as much at a text's end as at its start. The
difference of the two sums by the bytes of the text is the one feature; a logistic fit on labelled
texts that no dictionary was built from turns it into a probability. (By bytes and not by compressed
bytes, as texts that repeat themselves are small either way.)

Bounds of what is learnt from: ``SAMPLE_ROWS`` rows of each label. Of every other row the driver gets the whole
text, as long as those of one label stay within ``SAMPLE_BYTES``; these make the dictionary. All other rows, those
that no longer fit or are longer by themselves included, are measured whole, where they are, for the calibration. The model is two dictionaries
of ``DICTIONARY`` bytes.

Defined cases: a row without an id is left out; null or empty texts get the score at no difference; a very long text is a block of its own, read piece by piece; with too few texts
for a dictionary of one label, that dictionary is the texts themselves, each different piece once; without labels all scores
are 0.5; repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb
from lacuna.llm.labelled import fold, logistic, sigmoid, training, weights

SAMPLE_ROWS, SAMPLE_BYTES = 2000, 64 << 20
DICTIONARY, PIECE, LEVEL = 512 << 10, 1024, 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    beta: np.ndarray
    level: int = LEVEL

    def measure(self):
        """A function from bytes to the normalised difference."""
        import zstandard as z

        makers = []
        for raw in (self.good, self.bad):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=self.level)
            makers.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

        def of(text: bytes) -> float:
            good, bad = (sum(len(m.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE)) for m in makers)
            return (bad - good) / max(len(text), 1)

        return of

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return sigmoid(difference * self.beta[0] + self.beta[1])


def _dictionary(pieces: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, pieces).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(pieces)).ljust(8)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pieces of the texts."""
    for block in wb.blocks(batches):
        ids, labels = block.column("doc_id"), block.column("label").tolist()
        for i in range(len(block)):
            text = block.text(i)
            held = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
            n = len(held)
            yield pa.RecordBatch.from_arrays([pa.array([labels[i]] * n, pa.int32()), pa.array(np.full(n, ids[i])), pa.array(np.arange(n), pa.int64()), pa.array(held, pa.binary())], names=["label", "doc_id", "place", "piece"])


def _fitting(sizes: list[int], most: int) -> list[bool]:
    """Which texts, taken in order, stay within ``most`` bytes together; one too long for what is left is passed over."""
    out, left = [], most
    for n in sizes:
        out.append(n <= left)
        left -= n if n <= left else 0
    return out


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.measure()
        for block in wb.blocks(batches):
            got = [of(block.text(i)) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), block.rows.column("label"), pa.array(got, pa.float64())], names=["doc_id", "label", "difference"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Learn from a bounded sample of the training fold: whole texts for the dictionaries, other whole texts for the calibration."""
    known, totals = training(docs, labels, label, SAMPLE_ROWS)
    # ids, labels and sizes of 2 * SAMPLE_ROWS rows at most
    rows = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("size")).toPandas().sort_values(["h", "doc_id"])
    even = rows[rows.groupby("label").cumcount() % 2 == 0]
    even = pd.concat([of[_fitting(of["size"].tolist(), SAMPLE_BYTES)] for _, of in even.groupby("label")] or [even])
    place = {d: i for i, d in enumerate(even["doc_id"].tolist())}
    of_even = F.col("doc_id").isin(list(place))
    # 2 * SAMPLE_BYTES at most
    held = known.where(of_even).mapInArrow(_pieces, "label int, doc_id long, place long, piece binary").toPandas()
    held = held.assign(rank=held["doc_id"].map(place)).sort_values(["rank", "place"])
    good, bad = (_dictionary([bytes(x) for x in held["piece"][held["label"] == k]]) for k in (1, 0))
    model = QualityModel(good, bad, np.zeros(2))
    # two dictionaries of DICTIONARY bytes, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = known.where(~of_even).mapInArrow(_measured(shared), "doc_id long, label int, difference double").toPandas().sort_values(["label", "doc_id"])
    wb.forget(known)
    if len(seen):
        y = seen["label"].to_numpy(float)
        beta = logistic(seen[["difference"]].to_numpy(float), y, weights(y, np.ones(len(y)), totals))
        return QualityModel(good, bad, beta)
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        of = model.measure()
        for block in wb.blocks(batches):
            got = np.array([of(block.text(i)) for i in range(len(block))], float)
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(model.probability(got)), pa.array(got)], names=["doc_id", "score", "difference"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference) of every document; scoring is map-only."""
    docs = wb.doc_text(docs, id_col, text_col)
    # two dictionaries of DICTIONARY bytes, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    out = docs.mapInArrow(_scored(shared), "doc_id long, score double, difference double")
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")


def _good(shared, text_col: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        of = model.measure()
        for batch in batches:
            got = np.array([of((t.as_py() or "").encode()) for t in batch.column(text_col)], float)
            yield batch.filter(pa.array(model.probability(got) >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(wb.doc_text(docs, id_col, text_col), labels, label))
    return docs.mapInArrow(_good(shared, text_col, threshold), docs.schema)

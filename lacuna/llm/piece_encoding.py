"""Piece encoding that keeps offsets, and decoding.

Method: a text is normalised by the longest prefixes of the model's compiled character map, and every byte
of the normal form keeps the source byte that it comes from. Adjacent pieces are merged by score, the
leftmost of equal pairs first, and each piece's bounds are projected through those sources to a span of
bytes of the original text. Decoding puts the texts of the pieces together again.

The merge runs word by word, where a word ends at places that no piece of the vocabulary reaches over, so
that equal words are merged once in a worker (``KEPT_PIECES`` bounds what it keeps). The model's file is read
by the driver and sent with the tasks; files over ``MODEL_BYTES`` are refused. Map-only: no shuffle.

A null text is an empty one and has no pieces. Rows without an id are left out; repeated rows give equal
rows each; ties between pairs go to the leftmost. Texts are encoded whole, however long: a worker holds one
block of ``wordblock.BLOCK_BYTES`` or one longer text with some 30 bytes for each of its bytes. A byte that
belongs to no character counts as U+FFFD. An empty table gives an empty result, further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb
from lacuna.llm.piece_model import PieceModel

SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
MODEL_BYTES = 16 << 20

#: Models of this worker by the hash of their file.
_models: dict[bytes, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model has more than {MODEL_BYTES} bytes")
    return data


def _encode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for block in wb.blocks(batches):
            ids, begins, ends, first = model.encode(map(block.text, range(len(block))))
            flat = ids.tolist()
            decoded = [model.decode(flat[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            cols = [wb.lists(x, first, pa.int32()) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(block.column("doc_id").astype(np.int64)), *cols, pa.array(decoded, pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return run


def encode(docs, model: bytes, id_col: str = "doc_id", text_col: str = "text"):
    """Ids of each text, the span of bytes of the original that each covers, and the text that the ids decode to.

    ``model`` is the content of the file (``read_model``). Of the byte pieces of one character the last has
    its span and those before an empty one; so has a leading space that the text itself lacks.
    """
    PieceModel(data=model)  # what it does not read is refused here, not in a task
    return wb.doc_text(docs, id_col, text_col).mapInArrow(_encode(model), SCHEMA)


def decode(frame, model: bytes, ids_col: str = "ids", out_col: str = "decoded"):
    """Add the text of an array of ids; null for a null array."""

    @F.pandas_udf("string")
    def text(ids):
        own = _model(model)
        return ids.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return frame.withColumn(out_col, text(F.col(ids_col).cast("array<int>")))


def digests(encoded):
    """Number of ids, and hashes of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

"""Whole texts as numpy blocks: words, word hashes and shingle hashes without a Python loop.

Texts arrive as Arrow string columns, so their UTF-8 bytes already lie side by side. A block is a
run of whole documents of about ``BLOCK_BYTES`` bytes (a longer document is a block of its own),
which bounds what a worker holds whatever the size of a batch.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21

#: Bytes that separate words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside [0-9a-z] and beyond ASCII, once A-Z is lowered.
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Drawn anew by each driver. Word hashes keyed by it cannot be foreseen, so no words can be made up that share one. Functions that
#: run in tasks take it along from the driver (the workers' own is another one).
KEY = secrets.randbits(64)

_MASK = (1 << 64) - 1
#: Words of more bytes than this go through a keyed byte hash.
LONG = 64
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Odd multipliers for the places of a shingle, from one recurrence.
_PLACE = [((0xD6E8FEB86659FD93 * (2 * i + 1)) ^ (0xA0761D6478BD642F >> (i % 7))) & _MASK | 1 for i in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Block:
    """Documents ``rows`` (a RecordBatch without the text), their bytes and the bounds of each."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)

    def words(self, lower: bool, alnum: bool = False) -> "Words":
        return Words(self, lower, alnum)


class Words:
    """Byte bounds of all words of a block; ``first[d]`` to ``first[d + 1]`` are those of document d."""

    def __init__(self, block: Block, lower: bool, alnum: bool):
        data = _LOWER[block.data] if lower else block.data
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~(_NOT_ALNUM if alnum else _SPACE)[data]
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        bounds = block.offsets[1:-1]
        bounds = bounds[bounds < len(data)]
        begins[bounds] = inside[bounds]
        ends = inside[:-1] & ~inside[1:]
        cut = bounds[bounds > 0] - 1
        ends[cut] |= inside[cut]
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, block.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, key: int = 0) -> np.ndarray:
        """One 64-bit hash for each word, the same for equal words in any block.

        Eight bytes are taken at a time, each step a mix of all before it, from ``key`` and the length on; a word over
        ``LONG`` bytes is hashed by keyed BLAKE2. The steps can be undone, so with a known key words of 16 bytes that share a
        hash are found at once: where a result rests on hashes alone, ``KEY`` is the key.
        """
        n = self.end - self.start
        with np.errstate(over="ignore"):
            h = mix(n.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) ^ np.uint64(key))
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        at = np.flatnonzero(n <= LONG)
        for j in range(0, LONG, 8):
            at = at[n[at] > j]
            if not len(at):
                break
            h[at] = mix(h[at] ^ (eight[self.start[at] + j] & _KEEP[np.minimum(n[at] - j, 8)]))
        for i in np.flatnonzero(n > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, key=b"word" + key.to_bytes(8, "little")).digest(), "little")
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries; the last k - 1 places are cut off."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * np.uint64(_PLACE[j])
    return mix(out)


def owner_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches into blocks; a null text is an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if column.null_count:
            column = pc.fill_null(column, "")
        rest = batch.select([c for c in batch.schema.names if c != text])
        wide = pa.types.is_large_string(column.type)
        _, offs, data = column.buffers()
        offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            lo, hi = offsets[at], offsets[upto]
            yield Block(rest.slice(at, upto - at), raw[lo:hi], offsets[at : upto + 1] - lo)
            at = upto


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def doc_text(docs, id_col: str = "doc_id", text_col: str = "text"):
    """The two columns that operators read, under fixed names, whatever else the table has.

    A null text is an empty one. A row without an id is left out: no result could name it.
    """
    from pyspark.sql import functions as F

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark) -> str:
    """A fresh folder below the shared checkpoint folder of the session (its own one only where unset)."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return f"{base.rstrip('/')}/lacuna-{uuid.uuid4().hex}"


def _own_dir(spark) -> str:
    import tempfile

    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lacuna-checkpoint-")


def keep(df, name: str = "part"):
    """Cut lineage: write to the shared folder and read again. Survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*kept) -> None:
    """Delete tables of ``keep`` that later kept ones have replaced (None is passed over)."""
    for df in kept:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def row_by_row(spark, rows: int = 1):
    """Large rows go to Python one, or so many, in a batch, for the tables written within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark) -> None:
    """Shuffle files go once nothing refers to them: collect the garbage of both sides now, not at some time."""
    import gc
    import time

    for _ in range(2):  # what the first round frees may hold the last reference to something else
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)

"""Harmonic packing of token ids into sequences of a fixed capacity C.

Lengths are partitioned at the reciprocals of the capacity: class k has pieces of more than C / (k + 1)
and at most C / k ids, and a bin of class k holds exactly k pieces, whatever their lengths. Pieces of
at most C / ``CLASSES`` are the last class; they fill bins one after the other.

A document is cut into as many pieces of C ids as it holds. What remains stays whole if a bin full of
such pieces would be padded by C / ``SLACK`` ids at most. Else a piece of the next class's full size, C / (k + 1),
is cut off, and what is left of it goes on in the same way. So no bin has more padding than C / ``SLACK``.

Every task fills its own bins and knows nothing of other tasks: no shuffle, no counts to exchange. The
up to k - 1 pieces that a class has left at the end of a task are put together first fit, longest first; they
are no more than ``CLASSES`` squared, halved.

Sequence ids are unique over tasks (task number << 40, plus a running number) and the same again
when a task is repeated, since they follow from the task's rows alone.

Ids: by the tokenizers library. Where a vocabulary file normalises and splits as ``word_bpe_49k.json`` does, ids of
a pre-token are asked for once and kept in a table of bounded size, but for texts where that could differ;
with any other file every text goes through the library as a whole.

Defined cases: a row without an id is left out, with its tokens; null or empty text: the end id alone, one piece of length 1; empty table: no rows;
repeated rows: each is packed; pieces of equal length: in the order in which they come; extra columns are ignored; very long texts are cut into many pieces.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lacuna.llm import wordblock as wb

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_SCHEMA = SCHEMA + ", ids array<int>"
CAPACITY, END_ID = 2048, 1
CLASSES, SLACK = 64, 32
WORDS_KEPT = 300_000

# How the vocabulary file that ``Ids`` has a short way for prepares texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: The same split of lower-cased text, for texts of ASCII and Latin letters (_PLAIN).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: ASCII without controls other than white space, and the letters of Latin-1 and Latin Extended-A,
#: without those that case or composition treats in a way of its own.
_PLAIN = re.compile("[\t\n\v\f\r -~À-ÖØ-öø-įĹ-ňŌ-ž]*")

#: How byte-level vocabularies spell bytes: printable ones as themselves, the rest from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_coders: dict[str, "Ids"] = {}


class Ids:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    No pre-token holds white space, so what stands between white space is looked up as one; what the
    table lacks is split into pre-tokens and given to the tokenizer's model.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self._tokenizer, self._kept, self._of = Tokenizer.from_file(path), kept, {}
        self._model, self._words = self._tokenizer.model, {}
        told = json.loads(self._tokenizer.to_str())
        steps = (told.get("normalizer") or {}).get("normalizers"), (told.get("pre_tokenizer") or {}).get("pretokenizers")
        self._short = steps == (NORMALIZER, PRE_TOKENIZER) and not told["model"].get("dropout")

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            got = array("I", [t.id for t in self._model.tokenize(spelt)]).tobytes()
            if len(self._words) >= self._kept:
                self._words.clear()
            self._words[word] = got
        return got

    def _learn(self, chunk: str) -> bytes:
        return self._word(chunk) if chunk.isalpha() else b"".join(map(self._word, _SPLIT.findall(chunk)))

    def encode(self, text: str) -> bytes:
        if not self._short or "<|" in text or not _PLAIN.fullmatch(text):
            return self._whole(text)
        chunks, of = text.lower().split(), self._of
        new = set(chunks).difference(of)
        if new:
            if len(of) + len(new) > self._kept:  # the older half has the frequent ones
                of = self._of = dict(itertools.islice(of.items(), self._kept // 2))
                new = set(chunks).difference(of)
            for c in new:
                of[c] = self._learn(c)
        return b"".join(map(of.__getitem__, chunks))


class Bins:
    """The open bin of each class. Items put in are (length, row); ``done`` has (row, sequence, offset) of pieces in closed bins."""

    def __init__(self, capacity: int, base: int):
        self._capacity, self._next = capacity, base
        self._small = max(1, capacity // CLASSES)
        self._open: dict[int, list[tuple[int, list]]] = {}
        self._filled = 0  # ids in the open bin of small pieces
        self.done: list[tuple[list, int, int]] = []

    def cut(self, n: int) -> Iterator[tuple[int, int]]:
        """(class, length) of the pieces of a document of n ids; class 0 is that of small ones, which may be cut where a bin ends."""
        c = self._capacity
        for _ in range(n // c):
            yield 1, c
        n %= c
        while n:
            k = c // n
            if c - k * n <= c // SLACK and n > self._small:
                part = n
                yield k, part
            elif n > self._small and c // (k + 1) > self._small:
                part = c // (k + 1)
                yield k + 1, part
            else:
                part = min(n, c - self._filled)
                self._filled = (self._filled + part) % c
                yield 0, part
            n -= part

    def put(self, k: int, length: int, row: list) -> None:
        held = self._open.setdefault(k, [])
        held.append((length, row))
        if k and len(held) == k or not k and not self._filled:
            self._open[k] = []
            self._sequence(held)

    def _sequence(self, held: list[tuple[int, list]]) -> None:
        at = 0
        for length, row in held:
            self.done.append((row, self._next, at))
            at += length
        self._next += 1

    def close(self) -> None:
        """Put what is left into bins together."""
        left = sorted((x for _, held in sorted(self._open.items()) for x in held), key=lambda x: -x[0])
        self._open, self._filled = {}, 0
        bins: list[tuple[int, list]] = []
        for x in left:
            i = next((i for i, (room, _) in enumerate(bins) if room >= x[0]), len(bins))
            if i == len(bins):
                bins.append((self._capacity, []))
            room, held = bins[i]
            held.append(x)
            bins[i] = room - x[0], held
        for _, held in bins:
            self._sequence(held)


def _pack(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        if path not in _coders:  # kept by the worker for its next tasks
            _coders[path] = Ids(path)
        bins, coder = Bins(capacity, (task.partitionId() if task else 0) << 40), _coders[path]
        end = np.array([end_id], "<u4").tobytes()
        for block in wb.blocks(batches):
            for doc, i in zip(block.column("doc_id").tolist(), range(len(block)), strict=True):
                ids = coder.encode(block.text(i).decode()) + end
                total, at = len(ids) // 4, 0
                for k, size in bins.cut(total):
                    own = ids[4 * at : 4 * (at + size)]
                    row = [doc, at, size, zlib.crc32(own), total]
                    if keep_ids:
                        row.append(own)
                    bins.put(k, size, row)
                    at += size
                if len(bins.done) > 20_000:
                    yield _batch(bins.done, keep_ids)
                    bins.done = []
        bins.close()
        if bins.done:
            yield _batch(bins.done, keep_ids)

    return run


def _batch(rows: list[tuple[list, int, int]], keep_ids: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    table = np.array([(*r[:5], s, o) for r, s, o in rows], np.int64)
    cols = [pa.array(table[:, i].copy()) for i in range(7)]
    if keep_ids:
        flat = np.frombuffer(b"".join(r[5] for r, _, _ in rows), "<u4").astype(np.int32)
        cols.append(wb.lists(flat, np.concatenate(([0], np.cumsum(table[:, 2]))), pa.int32()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def pack(docs, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True):
    """Pieces of all documents with their sequence and offset; ``ids`` too if ``keep_ids``. Map-only."""
    if capacity < 1:
        raise ValueError("the capacity has to be 1 at least")
    return wb.doc_text(docs, id_col, text_col).mapInArrow(_pack(tokenizer_path, capacity, end_id, keep_ids), PIECES_SCHEMA if keep_ids else SCHEMA)

"""Benchmark passages in documents: SimHash over item-sized windows, multi-index Hamming search, exact check.

* A window has as many words as an item, or all words of a document that has fewer; its fingerprint is the 128-bit SimHash of its 5-word
  shingles (A-Z lowered, each as often as it stands there).
* Fingerprints of items are indexed by 16 blocks of 8 bits. Two fingerprints within ``RADIUS`` = 31
  bits differ by one bit at most in some block, so each block has posting lists: of each value the items
  whose block differs from it by one bit at most. The lists of a fingerprint's 16 values hold
  all items within the radius, without exception.
* A candidate counts if its weighted similarity is ``SIMILARITY`` or more: over shingles, the sum of the
  smaller counts by the sum of the larger ones. At 0.8 fingerprints are expected to differ in 19 bits.
* Windows that share no shingle with an item of their size have similarity 0 and get no fingerprint.

Items of equal text are one, under the smallest of their ids. Items go out in blocks of about ``ITEM_BYTES`` (their
bytes are summed before any is collected, and blocks split until they fit; an item larger than that is a block of
its own); all documents are scanned for each block, map-only, so a passage in a third of all rows costs nothing extra.

Defined cases: a row without an id is left out; null or empty texts and items match nothing; an item of fewer than 5 words is its one
shingle and matches equal words; equal items are reported once, with their number; of equally similar windows the first is
reported; repeated documents are each reported; a very long text is scanned in parts of ``PART`` windows; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb

WIDTH, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 31, 16
ITEM_BYTES, PART = 8 << 20, 8192
#: Pairs of windows and items that are looked at together, about.
PAIRS = 2_000_000
_SCHEMA = "doc_id long, item_id long, n_items long, first_word long, n_words long, similarity double, hamming int"
#: Of each value of a block the values that differ by one bit at most.
_NEAR = np.arange(256)[:, None] ^ np.array([0, *(1 << i for i in range(8))])


def _signs(h: np.ndarray) -> np.ndarray:
    """128 votes of +1 or -1 for each shingle."""
    both = np.stack((h, wb.mix(h ^ np.uint64(0x2545F4914F6CDD1D))), axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.int32) * 2 - 1


def simhash(votes: np.ndarray) -> np.ndarray:
    """Fingerprints (16 bytes each) of summed votes."""
    return np.packbits(votes > 0, axis=1)


class Items:
    """Items of one block by size, with their fingerprints and the multi-index."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], many: list[int] | None = None):
        self.many = dict(zip(ids.tolist(), many or [1] * len(ids), strict=True))
        self.by_size: dict[int, dict] = {}
        of_shingle: dict[int, dict[int, set[int]]] = {}
        for i, h in zip(ids.tolist(), words, strict=True):
            if not len(h):
                continue
            width = min(WIDTH, len(h))
            s = wb.shingles(h, width)
            group = self.by_size.setdefault(len(h), {"ids": [], "bags": [], "prints": []})
            group["ids"].append(i)
            group["bags"].append(Counter(s.tolist()))
            group["prints"].append(simhash(_signs(s).sum(0, keepdims=True))[0])
            for x in s.tolist():
                of_shingle.setdefault(width, {}).setdefault(x, set()).add(len(h))
        for group in self.by_size.values():
            group["prints"] = np.array(group["prints"], np.uint8)
            group["lists"] = [_postings(group["prints"][:, b]) for b in range(BLOCKS)]
        #: For each width of shingles: their sorted hashes, and the sizes of the items that have them.
        self.gates = {}
        for width, found in of_shingle.items():
            keys = np.array(sorted(found), np.uint64)
            self.gates[width] = keys, [sorted(found[k]) for k in keys.tolist()]

    def hits(self, h: np.ndarray, width: int) -> np.ndarray:
        keys, _ = self.gates[width]
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[k] == h, k, -1)

    def candidates(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all items of this size within the radius."""
        group = self.by_size[size]
        n = len(group["ids"])
        step = max(1, PAIRS // n)
        for lo in range(0, len(prints), step):
            part, found = prints[lo : lo + step], []
            for b, (bounds, items) in enumerate(group["lists"]):
                first, many = bounds[part[:, b]], np.diff(bounds)[part[:, b]]
                ends = np.cumsum(many)
                entry = np.arange(int(ends[-1])) + np.repeat(first - ends + many, many)
                found.append(np.repeat(np.arange(len(part)) * n, many) + items[entry])
            pairs = np.unique(np.concatenate(found))
            w, k = pairs // n, pairs % n
            distance = np.bitwise_count(part[w] ^ group["prints"][k]).sum(1)
            near = distance <= RADIUS
            for a, c, d in zip(w[near].tolist(), k[near].tolist(), distance[near].tolist(), strict=True):
                yield lo + a, c, d


def _postings(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the list of each value begins, items): of each block value the items that have it or a neighbour."""
    value, item = _NEAR[values].ravel(), np.repeat(np.arange(len(values)), _NEAR.shape[1])
    order = np.argsort(value, kind="stable")
    return np.searchsorted(value[order], np.arange(257)), item[order]


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


def _scan_document(items: Items, shingles: np.ndarray, width: int, hit: np.ndarray, n_words: int) -> dict[int, tuple]:
    """Best window for each item: item -> (first word, size, similarity, distance)."""
    sizes: dict[int, list[int]] = {}
    for p in np.flatnonzero(hit >= 0).tolist():
        for n in items.gates[width][1][hit[p]]:
            sizes.setdefault(n, []).append(p)
    best: dict[int, tuple] = {}
    for n, places in sizes.items():
        size = min(n, n_words)
        inside = size - width  # last shingle of a window, from its first
        mark = np.zeros(len(shingles) + 1, np.int64)
        p = np.array(places)
        np.add.at(mark, np.maximum(p - inside, 0), 1)
        np.add.at(mark, p + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        starts = starts[starts + size <= n_words]
        while len(starts):
            upto = int(np.searchsorted(starts, starts[0] + PART))
            part, starts = starts[:upto], starts[upto:]
            base, end = part[0], part[-1] + inside + 1
            sums = np.concatenate((np.zeros((1, 128), np.int32), np.cumsum(_signs(shingles[base:end]), axis=0)))
            prints = simhash(sums[part + inside + 1 - base] - sums[part - base])
            for w, k, d in items.candidates(n, prints):
                at = int(part[w])
                s = weighted_similarity(items.by_size[n]["bags"][k], Counter(shingles[at : at + inside + 1].tolist()))
                key = (-s, at)
                item = (n, k)
                if s >= SIMILARITY and (item not in best or key < best[item][0]):
                    best[item] = (key, at, s, d)
    return {(items.by_size[n]["ids"][k], n, k): (at, min(n, n_words), s, d) for (n, k), (_, at, s, d) in best.items()}


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for block in wb.blocks(batches):
            words = block.words(lower=True)
            h, first, rows = words.hashes(), words.first, []
            ids = block.column("doc_id")
            for width in items.gates:
                s = wb.shingles(h, width)
                found = items.hits(s, width)
                at = np.flatnonzero(found >= 0)
                for d in np.unique(np.searchsorted(first, at, side="right") - 1).tolist():
                    a, b = int(first[d]), int(first[d + 1])
                    own = max(0, b - a - width + 1)
                    got = _scan_document(items, s[a : a + own], width, found[a : a + own], b - a)
                    rows += [(int(ids[d]), item, items.many[item], *v) for (item, _, _), v in got.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return run


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_items, first_word, n_words, similarity, hamming): for each document and item in it, the best window."""
    spark = docs.sparkSession
    docs = wb.doc_text(docs, id_col, text_col)
    same = wb.doc_text(benchmark, item_col, item_text).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("many"))
    items = wb.keep(same, "items")
    out = None
    for part, parts in _blocks_of_items(items):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).toArrow().combine_chunks()
        ids, many, words = [], [], []
        for block in wb.blocks(iter(rows.to_batches()), limit=1 << 40):
            w = block.words(lower=True)
            h = w.hashes()
            ids += block.column("doc_id").tolist()
            many += block.column("many").tolist()
            words += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        # about ITEM_BYTES of items
        found = docs.mapInArrow(_scan(spark.sparkContext.broadcast(Items(np.array(ids, np.int64), words, many))), _SCHEMA)
        out = found if out is None else out.union(found)
    wb.forget(items)
    return out


def _blocks_of_items(items: DataFrame) -> Iterator[tuple[int, int]]:
    """(part, parts): hash classes of items, split in two until each has ``ITEM_BYTES`` at most or one item; (0, 1) where there are none."""
    size = items.select(F.xxhash64("text").alias("h"), F.octet_length("text").alias("b"))
    waiting = [(0, 1)]
    while waiting:
        part, parts = waiting.pop(0)
        n, total = size.where(F.pmod("h", F.lit(parts)) == part).agg(F.count("*"), F.sum("b")).first()
        if n > 1 and total > ITEM_BYTES:
            waiting += [(part, 2 * parts), (part + parts, 2 * parts)]
        elif n or parts == 1:
            yield part, parts

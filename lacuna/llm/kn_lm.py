"""Interpolated modified Kneser-Ney of any order from 2, counted in Spark and looked up as sorted hash arrays.

The model is as large as the corpus, so neither a worker nor the driver ever holds all of it. Texts
are cut into chunks of about ``CHUNK_BYTES``; what a chunk asks about is reduced to its distinct
hashes first, in numpy, and travels as compressed arrays, one for each chunk and range of hashes:

1. Chunks: ids, fold and tokens of their documents, as numbers into the chunk's own vocabulary. They are written once.
2. The longest grams. Each range of hashes merges the chunks' counts to one sorted hash array, which its
   worker keeps in a mapped file, and answers each chunk with the totals of its grams in
   the order asked. Of each gram seen in training one chunk is told that it owns it.
3. The next shorter grams, down to words. From the grams they own, one word longer, chunks report of each
   gram how many different words precede it, how many follow it once, twice, more often, and how often
   in all. Ranges merge and answer likewise. Of words their counts are reported too.
4. Chunks then get the answers of all orders and score their documents.

p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w | v'), v' without the first word of v. c is the count
of grams of the full order and of those that begin with the start mark, and the number of different
words before it for others; c(v) is the sum of c(vw) over w. Each order has three discounts D from its counts
of counts; g(v) is the discounted share. p(w) is the same over the number of different words before w,
interpolated with 1 / (V + 1). Probabilities of V words and one unknown sum to 1. A context not seen in
training leaves p(w | v'). The first word's context is one start mark, and no context reaches beyond it.

Defined cases: a row without an id is left out, of the counts too; a null or empty text is one end token; repeated rows count and score each; no training
row: every probability is 1 / (V + 1) with V = 0; an empty table gives an empty result; extra columns
are ignored; an order under 2 is refused. Nothing is pruned.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb
from lacuna.llm.labelled import fold

CHUNK_BYTES = 5 << 19
#: Distinct hashes for each range, about.
RANGE_KEYS = 500_000
#: Of what would lie on disk beside the answers of other orders, so many parts are shuffled one after the other: of chunks, or of hash ranges.
PARTS = 2
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)

_CHUNKS = "chunk long, n long, docs binary, held binary, lengths binary, vocab binary, tokens binary"
_ASKED = "chunk long, range int, keys binary, counts binary"
_TOLD = "chunk long, range int, totals binary, owned binary, stats array<long>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Numbers kept of each gram: count; of those that are contexts, the sum of what follows, followers seen once, twice, more often; of words, count of tokens.
_OF_LONGEST, _OF_CONTEXT, _OF_WORD = 1, 5, 6


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 32
    for k, block in enumerate(wb.blocks(batches, limit=CHUNK_BYTES)):
        words = block.words(lower=True)
        n = np.diff(words.first)
        h = np.full(len(words) + len(n), END, np.uint64)
        h[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words.hashes()
        vocab, tokens, _ = distinct(np.append(h, [END, START]))
        tokens = tokens[:-2]
        yield _row(_CHUNKS, base + k, len(tokens), block.column("doc_id").astype(np.int64).tobytes(), np.asarray(block.column("held_out"), bool).tobytes(), (n + 1).astype(np.int64).tobytes(), squeezed(spaced(vocab)), squeezed(planes(tokens)))


def distinct(values: np.ndarray, placed: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Sorted distinct hashes, the place of each value among them (None unless ``placed``), and where each hash is first.

    Hashes are sorted with their places in their lowest bits, which is some three times as fast as sorting places by
    hashes. Where two hashes differ in those bits alone and come out in the wrong order, places are sorted.
    """
    n = len(values)
    low = np.uint64((1 << n.bit_length()) - 1)
    tagged = values & ~low
    tagged |= np.arange(n, dtype=np.uint64)
    tagged.sort()
    order = (tagged & low).astype(np.int64)
    del tagged
    ranked = values[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(values, kind="stable")
        ranked = values[order]
    new = np.ones(n, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    place = None
    if placed:
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(new) - 1
    return ranked[new], place, order[new]


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next ones and so on; the higher planes hardly take room once compressed."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Counts, most of them small, as one byte each; those of 255 and more follow in full."""
    flat = values.ravel()
    large = flat[flat >= 255]
    return np.minimum(flat, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes() + np.array([len(large)], np.uint64).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    large = int.from_bytes(data[-8:], "little")
    body = np.frombuffer(data, np.uint8, len(data) - 8 - 4 * large).astype(np.int64)
    body[body == 255] = np.frombuffer(data[len(data) - 8 - 4 * large : len(data) - 8], np.uint32)
    return body


def spaced(keys: np.ndarray) -> bytes:
    """Sorted hashes as the lowest bytes of their differences, then the next ones and so on."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_spaced(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    import zstandard as z

    return z.ZstdCompressor(level=1).compress(data)


def restored(data: bytes) -> bytes:
    import zstandard as z

    return z.ZstdDecompressor().decompress(data)


def _columns(values: np.ndarray) -> bytes:
    """Rows of counts, column by column."""
    return squeezed(packed(values.T))


def _from_columns(data: bytes, width: int) -> np.ndarray:
    return unpacked(restored(data)).reshape(width, -1).T


_KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _row(schema: str, *values) -> pa.RecordBatch:
    return _batch(schema, [values])


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KIND[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


@dataclass
class Chunk:
    """The tokens of some documents, as places in a sorted vocabulary, and their distinct grams."""

    docs: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    vocab: np.ndarray

    @classmethod
    def of(cls, row: dict) -> "Chunk":
        return cls(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["held"], bool), np.frombuffer(row["lengths"], np.int64), from_planes(restored(row["tokens"])), from_spaced(restored(row["vocab"])))

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def place(self) -> np.ndarray:
        """Of each token, its place in its document."""
        return np.arange(len(self.tokens)) - np.repeat(self.starts(), self.lengths)

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of the k words up to each token, and each token's place among them: -1 where the document, with its start mark, has not so many."""
        return self.grams_at(k)[:2]

    def grams_at(self, k: int, placed: bool = True, among: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """``grams``, without places unless ``placed``, and the first token of each (None for words).

        Only hashes ``among`` are kept, if it is given (not for words); tokens of others have no place.
        """
        if k == 1:
            return self.vocab, self.tokens, None
        words, start = self.vocab[self.tokens], self.starts()
        h = words
        for j in range(2, k + 1):
            last = np.empty_like(h)
            last[1:] = h[:-1]
            if j == 2:
                last[start] = START
            with np.errstate(over="ignore"):
                h = wb.mix(last * np.uint64(0x9E3779B97F4A7C15) + words)
        if k == 2 and among is None:  # each token has a word or the start mark before it
            return distinct(h, placed)
        kept = self.place() >= k - 2
        whole = np.flatnonzero(kept if among is None else kept & among(h))
        keys, index, first = distinct(h[whole], placed)
        out = None
        if placed:
            out = np.full(len(h), -1)
            out[whole] = index
        return keys, out, whole[first]

    def contexts(self, index: np.ndarray, k: int) -> np.ndarray:
        """The place of the k words before each token, from those up to each token; -1 where there are none."""
        out = np.empty_like(index)
        out[1:] = index[:-1]
        out[self.starts()] = np.searchsorted(self.vocab, START) if k == 1 else -1
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _give_back() -> None:
    """Return freed memory to the system: workers wait idle between tasks, and allocators keep what they had at their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the hash ranges in sorted keys."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


def _width(k: int, order: int) -> int:
    return _OF_LONGEST if k == order else _OF_CONTEXT if k > 1 else _OF_WORD


def _table(chunk: Chunk, k: int, order: int, told: list[dict] | None, among: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's grams of k words (those ``among``, if given) and what it knows of them; ``told``: the answers for those of k + 1."""
    keys, index, _ = chunk.grams_at(k, among=among)
    table = np.zeros((len(keys), _width(k, order)), np.int64)
    count = lambda at, by=None: np.bincount(at, weights=by, minlength=len(keys))
    here = (lambda at: at[index[at] >= 0]) if among else (lambda at: at)
    train = chunk.training()
    if k == order:
        table[:, 0] = count(index[train & (index >= 0)])
        return keys, table
    longer, _, first = chunk.grams_at(k + 1, placed=False)
    totals, own = _answers(told, len(longer), _width(k + 1, order))
    totals = totals[own, 0]
    first = first[own]
    before = chunk.contexts(index, k)[first]
    if among:
        mine = before >= 0
        before, totals = before[mine], totals[mine]
    table[:, 0] = count(index[here(first)])
    if k > 1:  # those that begin with the start mark
        table[:, 0] += count(index[here(np.flatnonzero(train & (chunk.place() == k - 2)))])
    else:
        table[:, 5] = count(index[train])
    table[:, 1] = count(before, totals)
    for c, has in ((2, totals == 1), (3, totals == 2), (4, totals > 2)):
        table[:, c] = count(before[has])
    return keys, table


def _ask(k: int, order: int, ranges: int, part: int = 0, parts: int = 1):
    """Ask the ranges of one part."""
    def run(batches):
        for row in _rows(batches):
            # a part's grams alone are sorted and counted
            among = (lambda h: ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)) % np.uint64(parts) == part) if parts > 1 else None
            keys, table = _table(Chunk.of(row), k, order, row.get("told"), among)
            cut = _cuts(keys, ranges)
            yield _batch(_ASKED, [(row["chunk"], r, squeezed(spaced(keys[a:b])), _columns(table[a:b])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a and r % parts == part])
            del keys, table, row
            _give_back()

    return run


def _merge(width: int):
    """Merge the arrays of a hash range and answer every chunk with the totals of what it asked."""
    def run(table: pa.Table) -> pa.Table:
        asked = sorted((r for b in table.to_batches() for r in _rows([b])), key=lambda r: r["chunk"])
        ask = [from_spaced(restored(r["keys"])) for r in asked]
        # counts lie number by number, so that each is read and written in one run
        flat = np.concatenate([_from_columns(r["counts"], width).T for r in asked], axis=1)
        keys, index, _ = distinct(np.concatenate(ask))
        sums = np.stack([np.bincount(index, weights=of, minlength=len(keys)).astype(np.int64) for of in flat])
        owner = np.full(len(keys), len(index))
        # of equal places the last one written stays, so the first chunk's
        seen = np.flatnonzero(flat[0] > 0)[::-1]
        owner[index[seen]] = seen
        del index, flat
        # from here on the model's part is read where it is mapped
        hashes, totals, owners = _mapped(keys), _mapped(sums), _mapped(owner)
        del keys, sums, owner, seen
        out, at = [], 0
        for r, a in zip(asked, ask, strict=True):
            found = np.searchsorted(hashes, a)
            own = owners[found] == np.arange(at, at + len(a))
            at += len(a)
            out.append((r["chunk"], r["range"], _columns(np.stack([of[found] for of in totals]).T), squeezed(np.packbits(own).tobytes()), None))
        # how many have a count of 1, 2, 3, 4, more than 2; sum of counts; words with any count of tokens; tokens
        c, t = totals[0], totals[-1]
        out.append((-1, asked[0]["range"], None, None, [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c > 2).sum()), int(c.sum()), int((t > 0).sum()), int(t.sum())]))
        del asked, ask, hashes, totals, owners, c, t
        _give_back()
        return pa.Table.from_batches([_batch(_TOLD, out)])

    return run


def _mapped(values: np.ndarray) -> np.ndarray:
    """The values in a file of the worker's memory, mapped read-only: no folder of the machine is used, and it goes with the last reference."""
    if not values.size:
        return values
    with os.fdopen(os.memfd_create("hashes"), "w+b") as f:
        np.ascontiguousarray(values).tofile(f)
        f.flush()
        return np.memmap(f, values.dtype, "r", shape=values.shape)


def _answers(told: list[dict], size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the answers of all ranges in the order of the chunk's keys."""
    told = sorted(told, key=lambda t: t["range"])
    totals = [_from_columns(t["totals"], width) for t in told]
    own = [np.unpackbits(np.frombuffer(restored(t["owned"]), np.uint8))[: len(x)].astype(bool) for t, x in zip(told, totals, strict=True)]
    out = np.concatenate(totals)
    if len(out) != size:
        raise RuntimeError("a hash range did not answer")
    return out, np.concatenate(own)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the counts of counts; fixed ones where a count is missing."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    clip = lambda d, most: min(max(d, 0.05), most)
    return clip(1 - 2 * y * n2 / n1, 1), clip(2 - 3 * y * n3 / n2, 2), clip(d3, 3)


@dataclass
class Totals:
    longer: tuple[tuple[float, float, float], ...]
    word: tuple[float, float, float]
    with_one: int
    with_two: int
    with_more: int
    vocabulary: int
    types: int
    tokens: int

    def word_probability(self, before: np.ndarray) -> np.ndarray:
        """p(w) of words with so many different predecessors."""
        if not self.types:
            return np.full(len(before), 1 / (self.vocabulary + 1))
        d = np.choose(np.minimum(before, 3), (0.0, *self.word))
        rest = (self.word[0] * self.with_one + self.word[1] * self.with_two + self.word[2] * self.with_more) / self.types
        return (before - d) / self.types + rest / (self.vocabulary + 1)

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        """c(vw) less its discount, of k words."""
        return c - np.array((0.0, *self.longer[k - 2]))[np.minimum(c, 3)]

    def left(self, k: int, context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(v), 1 at least, and g(v) of contexts of k words, with followers seen once, twice, more; g(v) is 1 of a context that was not seen."""
        n = np.maximum(context, 1)
        once, twice, more = self.longer[k - 2]
        return n, np.where(context > 0, (after[:, 0] * once + after[:, 1] * twice + after[:, 2] * more) / n, 1.0)


def _score(totals: Totals, order: int):
    def run(batches):
        for row in _rows(batches):
            chunk = Chunk.of(row)
            told = lambda k, size: _answers([t for t in row["told"] if t["k"] == k], size, _width(k, order))[0]  # noqa: B023, E731
            keys, index = chunk.grams(1)
            known = told(1, len(keys))
            # what depends on a gram alone is worked out once for each, and looked up for the tokens
            seen = (known[:, 5] > 0)[chunk.tokens]
            base = np.log10((known[:, 5] + 1) / (totals.tokens + totals.vocabulary + 1))[chunk.tokens]
            p = totals.word_probability(known[:, 0])[chunk.tokens]
            for k in range(2, order + 1):
                before = chunk.contexts(index, k - 1)
                n, rest = totals.left(k, known[:, 1], known[:, 2:5])
                keys, index = chunk.grams(k)
                has = slice(None) if k == 2 else np.flatnonzero(index >= 0)
                known = told(k, len(keys))
                at, of = index[has], before[has]
                # a gram of a context that was not seen has no count
                p[has] = totals.discounted(k, known[:, 0])[at] / n[of] + rest[of] * p[has]
            p = np.log10(p)
            at = chunk.starts()
            yield pa.RecordBatch.from_arrays([
                pa.array(chunk.docs), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(np.add.reduceat(seen, at, dtype=np.int64)),
                pa.array(np.full(len(at), totals.tokens)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(p, at)),
            ], names=[f.split()[0] for f in _SCORES.split(", ")])
            del row, known, seen, p, base
            _give_back()

    return run


def _with_answers(chunks: DataFrame, told: dict[int, list[DataFrame]], part: int = 0, parts: int = 1) -> DataFrame:
    """Chunks, or a part of them, with one answer for each order and hash range."""
    own = (F.col("chunk") >= 0) & (F.pmod(F.xxhash64("chunk"), F.lit(parts)) == part)
    rows = [df.where(own).select("chunk", F.lit(k).alias("k"), "range", "totals", "owned") for k, of in told.items() for df in of]
    return chunks.where(own).join(reduce(DataFrame.union, rows).groupBy("chunk").agg(F.collect_list(F.struct("k", "range", "totals", "owned")).alias("told")), "chunk")


def _by_parts(chunks: DataFrame, told: dict[int, list[DataFrame]], run, schema: str, name: str) -> list[DataFrame]:
    out = []
    for part in range(PARTS):
        out.append(wb.keep(_with_answers(chunks, told, part, PARTS).mapInArrow(run, schema), f"{name}{part}"))
        wb.release(chunks.sparkSession)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held_out: int = 2, order: int = 2) -> DataFrame:
    """Learn from all documents outside the held-out fold and score all (see ``_SCORES``; log10)."""
    if order < 2:
        raise ValueError("the order has to be 2 at least")
    spark = docs.sparkSession
    docs = wb.doc_text(docs, id_col, text_col).withColumn("held_out", fold(parts=parts) == held_out)
    chunks = wb.keep(docs.mapInArrow(_chunks, _CHUNKS), "chunks")
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-tokens // RANGE_KEYS))

    told, sums = {}, {}
    with wb.row_by_row(spark):
        scores = _learnt(chunks, order, ranges, told, sums)
    wb.forget(chunks, *(df for of in told.values() for df in of))
    return reduce(DataFrame.union, scores)


def _learnt(chunks: DataFrame, order: int, ranges: int, told: dict, sums: dict) -> list[DataFrame]:
    """Count order by order, then score."""
    spark = chunks.sparkSession
    for k in range(order, 0, -1):
        merged = lambda asks, name: wb.keep(asks.groupBy("range").applyInArrow(_merge(_width(k, order)), _TOLD), name)  # noqa: B023, E731
        if k == order:
            told[k] = [merged(chunks.mapInArrow(_ask(k, order, ranges), _ASKED), f"told{k}")]
        elif k > 1:
            told[k] = []
            for part in range(PARTS):
                told[k].append(merged(_with_answers(chunks, {k + 1: told[k + 1]}).mapInArrow(_ask(k, order, ranges, part, PARTS), _ASKED), f"told{k}-{part}"))
                wb.release(spark)
        else:  # words are few
            asked = _by_parts(chunks, {k + 1: told[k + 1]}, _ask(k, order, ranges), _ASKED, "asked")
            told[k] = [merged(reduce(DataFrame.union, asked), f"told{k}")]
            wb.forget(*asked)
        wb.release(spark)
        # sums of the few numbers that each range has
        got = reduce(DataFrame.union, told[k]).where("chunk < 0").agg(*[F.sum(F.col("stats")[i]) for i in range(8)]).first()
        sums[k] = [int(x or 0) for x in got]

    w = sums[1]
    totals = Totals(tuple(discounts(*sums[k][:4]) for k in range(2, order + 1)), discounts(*w[:4]), w[0], w[1], w[4], w[6], w[5], w[7])
    return _by_parts(chunks, told, _score(totals, order), _SCORES, "scores")

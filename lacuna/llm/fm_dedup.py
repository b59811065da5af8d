"""Removal of passages that stand earlier in the corpus, by FM-indexes over shards.

Shards are cut by content, so that equal windows of ``WINDOW`` words meet in one shard and each
window is looked up there, not in all shards:

1. The anchor of a window is its smallest 6-gram by hash. Neighbouring windows with one place of the
   anchor are a piece; no two windows of a piece are equal. Anchors that occur once in the corpus
   cannot belong to a repeated window; pieces of the others are kept as places, without text.
2. Equal pieces are one class over the whole corpus, with its earliest place; at all other places the
   whole piece stands earlier. Classes alone in their anchor need no more.
3. Of anchors with several classes the earliest piece of each class goes to the anchor's shard, many in
   one row. Pieces of an anchor are ranked by place; for each bit of the ranks, a shard builds an
   FM-index of those that have 0 there and streams those that have 1 and agree in all higher bits.
   Any two pieces meet once, the later one being streamed against an index that holds the earlier one
   and not itself. Intervals of its matching statistics of ``WINDOW`` words or more are repeats.
4. Anchors with more than ``HOT`` classes would make a shard large: their pieces go out window by window,
   spread by the windows' own hashes. Of equal windows of a block only the earliest goes out, and none that a
   task knows an earlier place of; it remembers ``KNOWN`` to twice as many windows.
5. Answers come back in rows of many, are merged to one row for each document, and the words under
   repeated windows are taken out.

Windows are judged on the input. Words are told apart by 64-bit hashes keyed by the driver's secret, pieces by two of them.

Defined cases: a row without an id is left out; null or empty texts and texts of fewer than ``WINDOW`` words lose nothing; rows with
one id and one text are one document, of rows with one id and different texts the order is by a hash of the texts; an empty
table gives an empty result; extra columns are ignored; a very long text is a block of its own; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb
from lacuna.llm.fm_index import FMIndex, window_matches

WINDOW, GRAM = 20, 6
#: From this many different pieces on, an anchor's windows are spread one by one.
HOT = 256
#: Windows of such anchors that a task remembers, at least.
KNOWN = 1 << 18
#: Words of pieces for each shard, and of runs in each bucket of answers.
SHARD_WORDS, BUCKET_RUNS = 200_000, 1_000_000

#: A place within the documents of one id, in one number: 27 bits of the text's hash, 31 of the first word, 5 of the number of windows.
_SIG, _FIRST, _N = 36, 5, 31


def _loc(sig: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sig << _SIG | first.astype(np.int64) << _FIRST | n


def _first(loc: np.ndarray) -> np.ndarray:
    return loc >> _FIRST & (1 << 31) - 1


def _signed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lacuna_sig", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))), 37))


def _anchors(words: wb.Words, window: int, gram: int, secret: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a block: their first words, numbers of windows, anchors, and the words' hashes. Of equal smallest grams the leftmost is the anchor."""
    h, first = words.hashes(secret), words.first
    grams = wb.shingles(h, gram)
    own = wb.owner_of(first)
    starts = np.flatnonzero(np.arange(len(h)) + window <= first[1:][own]) if len(h) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), h
    spans = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), 1 << 16):
        part = starts[lo : lo + (1 << 16)]
        place[lo : lo + (1 << 16)] = part + spans[part].argmin(axis=1)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (own[starts[1:]] != own[starts[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), grams[place[at]], h


def _content(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the words of each piece, in order."""
    out = wb.mix(size.astype(np.uint64))
    for j in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > j)
        out[has] = wb.mix(out[has] * np.uint64(0x9E3779B97F4A7C15) ^ h[begin[has] + j])
    return out


def _first_pass(window: int, gram: int):
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches):
            _, _, value, _ = _anchors(block.words(lower=False), window, gram, secret)
            values, counts = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["value", "n"])

    return run


_RUNS = "value long, content long, doc_id long, loc long"


def _second_pass(window: int, gram: int):
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches):
            words = block.words(lower=False)
            begin, n, value, h = _anchors(words, window, gram, secret)
            own = wb.owner_of(words.first)[begin]
            ids, sig = block.column("doc_id")[own], block.column("lacuna_sig")[own]
            loc = _loc(sig, begin - words.first[own], n)
            cols = value.view(np.int64), _content(h, begin, n + window - 1).view(np.int64), ids, loc
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["value", "content", "doc_id", "loc"])

    return run


#: Many pieces in one row, as little-endian arrays: anchors, documents, places and word hashes. A row of a shard under 0 has
#: no pieces but answers of bucket -1 - shard.
_PIECES = "shard long, value binary, doc binary, loc binary, words binary"
_ANSWERS = "bucket long, doc binary, loc binary"


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (wb.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _gathered(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, places of its entries, their bytes in each column)."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1)) if len(key) else np.zeros(0, np.int64)
    for at in np.split(order, cuts[1:]) if len(cuts) else ():
        yield int(key[at[0]]), at, [c[at].tobytes() for c in columns]


class Earliest:
    """The earliest places of windows that went by, of the ``most`` last ones at least and of twice as many at most."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[int, tuple[int, int]] = {}
        self.old: dict[int, tuple[int, int]] = {}

    def unbeaten(self, value: np.ndarray, ids: np.ndarray, loc: np.ndarray) -> np.ndarray:
        """Which of these places have no earlier one of their window here or, as far as remembered, before."""
        order = np.lexsort((loc, ids, value))
        v, d, p = value[order], ids[order], loc[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(v)))
        same = (d == np.repeat(d[first], size)) & (p == np.repeat(p[first], size))  # repeated rows bring a place twice
        held = np.ones(len(first), bool)
        for i, (key, *place) in enumerate(zip(v[first].tolist(), d[first].tolist(), p[first].tolist(), strict=True)):
            known = self.young.get(key) or self.old.get(key)
            held[i] = known is None or tuple(place) <= known
            if len(self.young) >= self.most and key not in self.young:
                self.old, self.young = self.young, {}
            self.young[key] = tuple(place) if held[i] else known
        out = np.zeros(len(v), bool)
        out[order] = same & np.repeat(held, size)
        return out


def _cut(window: int, shards: int, buckets: int):
    """Pieces of documents' runs that an index has to decide. ``runs`` has (loc, value, kind): kind 2 as a whole, 3 window by window."""
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Earliest(KNOWN)
        for block in wb.blocks(batches):
            words = block.words(lower=False)
            h, runs = words.hashes(secret), block.rows.column("runs")
            bounds, flat = runs.offsets.to_numpy(), runs.values
            lo, hi = int(bounds[0]), int(bounds[-1])
            loc, value, kind = (flat.field(k).to_numpy(zero_copy_only=False)[lo:hi] for k in range(3))
            doc = np.repeat(np.arange(len(block)), np.diff(bounds))
            loc, value, kind, doc = loc[kind > 1], value[kind > 1], kind[kind > 1], doc[kind > 1]
            many = np.where(kind == 3, loc & _N, 1)
            rep = np.repeat(np.arange(len(loc)), many)
            inner = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            hot, doc, n = kind[rep] == 3, doc[rep], np.where(kind == 3, 1, loc & _N)[rep]
            first, ids = _first(loc)[rep] + inner, block.column("doc_id")[doc]
            loc = _loc(loc[rep] >> _SIG, first, n)
            begin, size = words.first[doc] + first, n + window - 1
            value = value[rep].astype(np.int64)
            value[hot] = _content(h, begin[hot], size[hot]).view(np.int64)
            out = np.ones(len(loc), bool)
            places = np.flatnonzero(hot)
            out[places] = sent.unbeaten(value[places], ids[places], loc[places])
            rows = [(-1 - b, b"", d, at, b"") for b, _, (d, at) in _gathered(_bucket(ids[~out], buckets), ids[~out], loc[~out])]
            value, ids, loc, begin, size = value[out], ids[out], loc[out], begin[out], size[out]
            for shard, at, (v, d, p) in _gathered((value.view(np.uint64) % np.uint64(shards)).astype(np.int64), value, ids, loc):
                rows.append((shard, v, d, p, h[_within(begin[at], size[at])].tobytes()))
            kinds = (pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _within(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... of each piece, side by side."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)


def _apart(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with a 0 before each and at the end, and where they begin there."""
    at = np.cumsum(size + 1) - size
    out = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    out[_within(at, size)] = symbols[_within(begin, size)]
    return out, at


def later_windows(value: np.ndarray, ids: np.ndarray, loc: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """Of the words of pieces, side by side, where a window starts that stands in an earlier piece of the same anchor."""
    size = (loc & _N) + window - 1
    begin = np.cumsum(size) - size
    found = np.zeros(len(words), bool)
    order = np.lexsort((loc, ids, value))
    twin = np.zeros(len(order), bool)  # repeated rows bring a piece of one place twice
    twin[1:] = (value[order[1:]] == value[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]]) & (loc[order[1:]] == loc[order[:-1]])
    order = order[~twin]
    same = np.flatnonzero(np.diff(value[order], prepend=value[order[:1]] - 1))
    count = np.diff(np.append(same, len(order)))
    rank, of = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    rank[order] = np.arange(len(order)) - np.repeat(same, count)
    of[order] = np.repeat(count, count)
    names = np.unique(words, return_inverse=True)[1].reshape(-1).astype(np.int64)
    for b in range(int(of.max(initial=1) - 1).bit_length()):
        group = rank >> b + 1
        meets = (group << b + 1) + (1 << b) < of  # its group of ranks has pieces with this bit
        early, late = np.flatnonzero(meets & (rank >> b & 1 == 0)), np.flatnonzero(meets & (rank >> b & 1 == 1))
        both = np.concatenate((early, late))
        # pieces that differ in a higher bit share no symbol
        own = names[_within(begin[both], size[both])] * (int(group.max()) + 1) + np.repeat(group[both], size[both])
        own = np.unique(own, return_inverse=True)[1].reshape(-1) + 1
        at = np.cumsum(size[both]) - size[both]
        text, _ = _apart(own, at[: len(early)], size[early])
        stream, start = _apart(own, at[len(early) :], size[late])
        hit = window_matches(FMIndex(text, window), stream, start, start + size[late])
        found[_within(begin[late], size[late])] |= hit[_within(start, size[late])]
    return found


def _shard(window: int, buckets: int):
    """Decide the pieces of a shard, and pass answers on."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard < 0:
            bucket = pa.array([-1 - shard] * table.num_rows, pa.int64())
            return pa.table({"bucket": bucket, "doc": table.column("doc"), "loc": table.column("loc")})
        value, ids, loc, words = (np.concatenate([np.frombuffer(x.as_py(), np.uint64 if c == "words" else np.int64) for x in table.column(c)]) for c in ("value", "doc", "loc", "words"))
        found = later_windows(value, ids, loc, words, window)
        size = (loc & _N) + window - 1
        piece = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(found)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
        b = np.flatnonzero(new)
        n, at = np.diff(np.append(b, len(at))), at[b]
        of = piece[at]
        ids, loc = ids[of], _loc(loc[of] >> _SIG, _first(loc[of]) + at - (np.cumsum(size) - size)[of], n)
        rows = [(k, *cols) for k, _, cols in _gathered(_bucket(ids, buckets), ids, loc)]
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("bucket", pa.int64()), ("doc", pa.binary()), ("loc", pa.binary())))})

    return run


def _merged(window: int):
    """One row for each document of a bucket, its overlapping runs joined."""
    def run(table: pa.Table) -> pa.Table:
        ids, loc = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)] or [np.zeros(0, np.int64)]) for c in ("doc", "loc"))
        order = np.lexsort((loc, ids))
        ids, loc = ids[order], loc[order]
        sig, first, n = loc >> _SIG, _first(loc), loc & _N
        doc = np.ones(len(ids), bool)
        doc[1:] = (ids[1:] != ids[:-1]) | (sig[1:] != sig[:-1])
        # ends grow along a document once earlier documents lie below all of its words
        base = (np.cumsum(doc) - 1) << 32
        end = np.maximum.accumulate(base + first + n)
        new = doc.copy()
        new[1:] |= base[1:] + first[1:] > end[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(ids)) - 1
        runs = pa.StructArray.from_arrays([pa.array(first[at].astype(np.int32)), pa.array((end[last] - base[last] - first[at]).astype(np.int32))], names=["first", "n"]) if len(at) else pa.array([], pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        bounds = np.append(np.cumsum(new)[doc] - 1, len(at)) if len(ids) else np.zeros(1, np.int64)
        return pa.table({"doc_id": pa.array(ids[doc]), "lacuna_sig": pa.array(sig[doc]), "found": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs)})

    return run


def repeated_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Runs of windows that stand earlier in the corpus, one row for each (doc_id, lacuna_sig): by classes
    (``runs``, those of kind 1), and by the indexes (``found``).

    ``docs`` has doc_id, text and lacuna_sig.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = docs.mapInArrow(_first_pass(window, gram), "value long, n long").groupBy("value").agg(F.sum("n").alias("seen")).where("seen > 1").select("value")
    repeated = wb.keep(repeated, "anchors")
    wb.release(spark)
    runs = wb.keep(docs.mapInArrow(_second_pass(window, gram), _RUNS).join(repeated, "value"), "runs")
    wb.forget(repeated)
    del repeated
    wb.release(spark)
    classes = wb.keep(runs.groupBy("value", "content").agg(F.min(F.struct("doc_id", "loc")).alias("rep")), "classes")
    several = classes.groupBy("value").agg(F.count("*").alias("classes")).where("classes > 1")
    classes_of = classes.join(several, "value", "left").select("value", "content", "rep", F.coalesce("classes", F.lit(1)).alias("classes"))
    first = (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("loc") == F.col("rep.loc"))
    kind = F.when(~first, 1).when(F.col("classes") > HOT, 3).when(F.col("classes") > 1, 2).otherwise(0)
    marked = runs.join(classes_of, ["value", "content"]).select("doc_id", F.shiftright("loc", _SIG).alias("lacuna_sig"), F.struct("loc", "value", kind.alias("kind")).alias("r"))
    # a document's runs are bounded by its words
    of_doc = wb.keep(marked.groupBy("doc_id", "lacuna_sig").agg(F.collect_set("r").alias("runs")), "of_doc")
    wb.forget(runs, classes)
    del runs, classes, several, classes_of, marked
    wb.release(spark)
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + F.when(r["kind"] == 2, r["loc"].bitwiseAND(_N) + window - 1).when(r["kind"] == 3, r["loc"].bitwiseAND(_N) * window).otherwise(0))
    words, entries = (int(x or 0) for x in of_doc.agg(F.sum(size), F.sum(F.size("runs"))).first())
    shards, buckets = max(least, -(-words // SHARD_WORDS)), max(least, -(-entries // BUCKET_RUNS))
    wanted = of_doc.where(F.exists("runs", lambda r: r["kind"] > 1))
    pieces = docs.join(wanted, ["doc_id", "lacuna_sig"]).mapInArrow(_cut(window, shards, buckets), _PIECES)
    answers = wb.keep(pieces.groupBy("shard").applyInArrow(_shard(window, buckets), _ANSWERS), "answers")
    del pieces, wanted
    wb.release(spark)
    found = wb.keep(answers.groupBy("bucket").applyInArrow(_merged(window), "doc_id long, lacuna_sig long, found array<struct<first:int,n:int>>"), "found")
    wb.forget(answers)
    wb.release(spark)
    return of_doc, found


def _covered(block: wb.Block, words: wb.Words, window: int) -> np.ndarray:
    """The words of a block under repeated windows."""
    gone = np.zeros(len(words) + 1, np.int64)
    for name in ("lacuna_runs", "lacuna_found"):
        runs = block.rows.column(name)
        valid = ~np.asarray(runs.is_null().to_numpy(zero_copy_only=False), bool)
        docs = np.repeat(np.arange(len(block)), np.where(valid, np.diff(runs.offsets.to_numpy()), 0))
        if not len(docs):
            continue
        flat = runs.drop_null().flatten()
        if name == "lacuna_runs":
            loc, kind = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            docs, first, n = docs[kind == 1], _first(loc[kind == 1]), loc[kind == 1] & _N
        else:
            first, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        np.add.at(gone, words.first[docs] + first, 1)
        np.add.at(gone, words.first[docs] + first + n + window - 1, -1)
    return np.cumsum(gone[:-1]) > 0


def _kept(block: wb.Block, window: int) -> Iterator[tuple[int, int, bytes]]:
    """Of each document: its words, how many stay, and those that stay joined by one space."""
    words = block.words(lower=False)
    at = np.flatnonzero(~_covered(block, words, window))
    cut = np.searchsorted(at, words.first)
    begin, end, data = words.start[at].tolist(), words.end[at].tolist(), block.data.tobytes()
    for d, n in enumerate(np.diff(words.first).tolist()):
        lo, hi = cut[d], cut[d + 1]
        yield n, int(hi - lo), b" ".join([data[a:b] for a, b in zip(begin[lo:hi], end[lo:hi], strict=True)])


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches):
            n, k, text = zip(*_kept(block, window), strict=True)
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(n, pa.int64()), pa.array([a - b for a, b in zip(n, k, strict=True)], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in text])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _rewritten(window: int, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches, text=text_col):
            texts = [block.text(d).decode() if n == k else t.decode() for d, (n, k, t) in enumerate(_kept(block, window))]
            new = {text_col: pa.array(texts, pa.string())}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([len(t) for t in texts], block.rows.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new[c] if c in new else block.rows.column(c) for c in columns], names=columns)

    return run


def _with_runs(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """All rows and columns, with the runs to take out of each."""
    by_class, found = repeated_runs(_signed(wb.doc_text(docs, id_col, text_col)), window)
    keyed = _signed(docs.withColumn("lacuna_id", F.col(id_col).cast("long")), text_col)
    for side in (by_class, found):
        side = side.withColumnRenamed("doc_id", "lacuna_id")
        keyed = keyed.join(side.select("lacuna_id", "lacuna_sig", *[F.col(c).alias(f"lacuna_{c}") for c in side.columns[2:]]), ["lacuna_id", "lacuna_sig"], "left")
    return keyed.select(*docs.columns, "lacuna_runs", "lacuna_found")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns and with repeated passages taken out of the texts (and ``n_chars`` set anew).

    A text that loses nothing stays as it is (a null one becomes empty); else its kept words are joined by one space.
    """
    return _with_runs(docs, id_col, text_col, window).mapInArrow(_rewritten(window, text_col, docs.columns), docs.schema)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document: the digest of its kept words joined by one space."""
    found = _with_runs(wb.doc_text(docs, id_col, text_col), "doc_id", "text", window)
    return found.mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")

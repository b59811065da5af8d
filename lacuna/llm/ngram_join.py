"""Similarity join of documents on their sets of word 5-grams, Jaccard 0.8 or more, by set size.

Sets are put in one global order (by how often a shingle's cell was seen, then by hash: frequent ones come last), so
two sets that share o elements or more share c of the first ``|r| - o + c`` of each.

* Light sets (up to x shingles) enumerate all subsets of c = 2 of that prefix, and meet others under
  an equal subset.
* Heavy sets scan the inverted lists of their prefix (c = 1). Light sets within the size ratio of
  heavy ones are in those lists too.
* The boundary x is where enumerating the subsets of a set costs more than scanning its lists; list
  lengths come from counts over the whole corpus. A list is read once in each round of pivots below and
  not once for each of its entries, so its length counts up to the number of rounds.

A group of m alike documents has m * m / 2 links that say no more than m of them. So in each round a
list has one pivot, and each document meets one pivot: the one it shares most lists with, among those
of other components than its own. Rounds end when they find no link; what is left between *different*
components is enumerated in full. No pair of sets that could link two components goes unchecked:
components are exact.

A candidate pair is dropped if the parity bitmaps of its sets differ in more bits than the sets may
(a proven bound), and else decided on the whole sets of both texts.

Most entries of the lists are alone in theirs. So entries travel packed, many to a row, to the range of
hashes of their key, which passes on those that have company. A key that a block of documents has
several times needs no such answer: its entries pass straight on, and the range learns of the key
once, so a list in a third of all rows does not meet in one task.

Copies (equal sets) are one class from the start. Sets are compared by 64-bit hashes of shingles, keyed by the driver's secret.

Defined cases: a row without an id is left out; null or empty text, or no word: an empty set, linked with nothing; fewer than 5
words: the whole sequence is the one shingle; rows of one id are one document, with the text of the smallest hash where they have
several, and each gets its row; a component is named by its smallest id, so ties have no part; a very long text is a block of its own;
an empty table gives an empty result; extra columns are ignored. No cap on list lengths or partners.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb
from lacuna.llm.graph import components

WIDTH, NUM, DEN = 5, 80, 100
#: A shingle counts as frequent in a window of documents from this many on. Counts are kept by cells of hashes, one byte each.
OFTEN, CELLS, WINDOW = 3, 1 << 22, 2_000_000
#: 64-bit words of the small bitmap that joins compare.
SMALL = 32
#: Lists of each document, the first by key, that tell whether a pair has met before.
FIRST = 8
#: Pairs of whole texts that are decided together, and bytes of their sets that are kept for the next ones.
PAIRS, SETS_BYTES = 64, 32 << 20
#: Rounds of pivots before the rest is enumerated; any number gives the same components.
ROUNDS = 5


def distinct_shingles(block: wb.Block, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, side by side, and their bounds."""
    words = block.words(lower=True)
    h, first = words.hashes(key), words.first
    n = np.diff(first)
    sh = wb.shingles(h, width)
    owner = wb.owner_of(first)
    ok = np.arange(len(sh)) + width <= first[1:][owner[: len(sh)]]
    values, own = sh[ok], owner[: len(sh)][ok]
    for d in np.flatnonzero((n > 0) & (n < width)):
        part = h[first[d] : first[d + 1]]
        with np.errstate(over="ignore"):
            whole = wb.shingles(part, len(part)) ^ np.uint64(0xA5A5A5A5 + len(part))
        values, own = np.append(values, wb.mix(whole)), np.append(own, d)
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    values, own = values[new], own[new]
    return values, np.searchsorted(own, np.arange(len(n) + 1))


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return sums[first[1:]] - sums[first[:-1]]


def _signatures(width: int):
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches):
            values, first = distinct_shingles(block, width, secret)
            a, b = _sum_by(wb.mix(values), first), _sum_by(wb.mix(values ^ np.uint64(0x5851F42D4C957F2D)), first)
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(np.diff(first)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", "n", "sig_a", "sig_b"])

    return run


def _often(width: int):
    """Shingles in ``OFTEN`` or more documents of a window, and of each window the shingles and repeats (key 0)."""
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            rare = counts < OFTEN
            often = ~rare
            repeats = int((counts[rare] * (counts[rare] - 1)).sum())
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], 1)), pa.array(np.append(np.zeros(often.sum(), np.int64), size)), pa.array(np.append(np.zeros(often.sum(), np.int64), repeats))], names=["key", "n", "total", "repeats"])

        for block in wb.blocks(batches):
            values, _ = distinct_shingles(block, width, secret)
            held.append(values)
            size += len(values)
            if size >= WINDOW:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return run


def _filled(table: pa.Table) -> pa.Table:
    """The levels of a part of the cells: how many binary digits the counts have."""
    levels = np.zeros(1 << 16, np.uint8)
    levels[table.column("cell").to_numpy() & 0xFFFF] = np.frexp(table.column("n").to_numpy().astype(float))[1]
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "levels": pa.array([levels.tobytes()], pa.binary())})


def _levels(often: DataFrame) -> np.ndarray:
    """One byte for each cell, whatever the input. Any value gives the same links; frequent cells are only to come last."""
    cells = often.where("total = 0").groupBy(F.pmod("key", F.lit(CELLS)).alias("cell")).agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.uint8)
    for r in cells.withColumn("part", F.shiftright("cell", 16)).groupBy("part").applyInArrow(_filled, "part long, levels binary").collect():
        out[r["part"] << 16 : (r["part"] + 1) << 16] = np.frombuffer(r["levels"], np.uint8)
    return out


def least_overlap(n):
    """The overlap that a set of n elements needs with any partner, at least."""
    return -(-NUM * n // DEN)


#: Entries of inverted lists, packed: a group of 0 and more is a range of keys, one below 0 passes its entries on.
_ENTRIES = "grp long, keys binary, docs binary, sizes binary, places binary"
_HITS = "key long, doc_id long, n long, place int"
#: In place of an entry: its key is in several documents. Of a subset, which has no place.
_SEVERAL, _NOWHERE = -2, -1
#: Distinct shingles of documents for each range of keys, about; they have some 0.3 entries each.
RANGE_SHINGLES = 250_000


def _entries(width: int, shared, boundary: int, ranges: int):
    """Per document the keys under which it is listed: subsets of two for light sets, prefix elements for heavy ones."""
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for block in wb.blocks(batches):
            values, first = distinct_shingles(block, width, secret)
            late, n = levels[(values & np.uint64(CELLS - 1)).astype(np.int64)], np.diff(first)
            own = wb.owner_of(first)
            ranked = np.lexsort((values, late, own))
            values = values[ranked]
            place = np.arange(len(values)) - first[own]
            size = n[own]
            heavy = (100 * size > NUM * boundary) & (place < size - least_overlap(size) + 1)
            keys, owners, places = [values[heavy]], [own[heavy]], [place[heavy]]
            light = n[(n > 0) & (n <= boundary)]
            for s in np.unique(light):  # all light sets of a size at once
                docs = np.flatnonzero(n == s)
                p = min(s, s - least_overlap(s) + 2)
                if p < 2:
                    continue
                prefix = values[first[docs][:, None] + np.arange(p)]
                i, j = np.triu_indices(p, 1)
                with np.errstate(over="ignore"):
                    sub = wb.mix(prefix[:, i] * np.uint64(0x9E3779B97F4A7C15) + prefix[:, j])
                keys.append(sub.ravel())
                owners.append(np.repeat(docs, len(i)))
                places.append(np.full(sub.size, _NOWHERE))
            key, owner, at = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
            order = np.argsort(key, kind="stable")
            key, owner, at = key[order], owner[order], at[order].astype(np.int32)
            lead = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            many = np.diff(np.append(lead, len(key)))
            several = np.repeat(many > 1, many)
            ids, size = block.column("doc_id"), n.astype(np.int32)
            told = key[lead[many > 1]]
            grp = np.concatenate((np.where(several, -1 - (wb.mix(ids[owner].astype(np.int64).view(np.uint64)) % np.uint64(ranges)).astype(np.int64), _range(key, ranges)), _range(told, ranges)))
            cols = [np.concatenate(c) for c in ((key, told), (ids[owner], np.zeros(len(told), np.int64)), (size[owner], np.zeros(len(told), np.int32)), (at, np.full(len(told), _SEVERAL, np.int32)))]
            order = np.argsort(grp, kind="stable")
            cuts = np.flatnonzero(np.diff(grp[order], prepend=grp[order[:1]] - 1))
            parts = np.split(order, cuts[1:]) if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(grp[p[0]]) for p in parts], pa.int64()), *[pa.array([c[p].tobytes() for p in parts], pa.binary()) for c in cols]], names=[x.split()[0] for x in _ENTRIES.split(", ")])

    return run


def _range(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _shared(table: pa.Table) -> pa.Table:
    """The entries of a range whose key another document has."""
    kinds = (("keys", np.uint64), ("docs", np.int64), ("sizes", np.int32), ("places", np.int32))
    key, doc, size, place = (np.concatenate([np.frombuffer(x.as_py(), k) for x in table.column(c)]) for c, k in kinds)
    if table.column("grp")[0].as_py() >= 0:
        lists, of = np.unique(key, return_inverse=True)
        of = of.reshape(-1)
        known = (np.bincount(of, weights=np.where(place == _SEVERAL, 2, 1), minlength=len(lists)) > 1)[of] & (place != _SEVERAL)
        key, doc, size, place = key[known], doc[known], size[known], place[known]
    return pa.table({"key": pa.array(key.view(np.int64)), "doc_id": pa.array(doc), "n": pa.array(size.astype(np.int64)), "place": pa.array(place)})


def _small() -> list[str]:
    return [f"s{i}" for i in range(SMALL)]


def _bitmaps(width: int):
    """Parity bitmaps of each set: one of a power of two near twice its size in bits, and a small one of fixed size."""
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in wb.blocks(batches):
            values, first = distinct_shingles(block, width, secret)
            n = np.diff(first)
            parity = lambda v, bits: np.packbits(np.bincount((v & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")
            small = np.zeros((len(n), SMALL), np.int64)
            maps = []
            for d in range(len(n)):
                own = values[first[d] : first[d + 1]]
                small[d] = parity(own, SMALL * 64).view(np.int64)
                maps.append(parity(own, max(256, 1 << int(2 * n[d]).bit_length())).tobytes())
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), pa.array(n), pa.array(maps, pa.binary()), *[pa.array(small[:, i].copy()) for i in range(SMALL)]], names=["doc_id", "n", "bits", *_small()])

    return run


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose bitmaps differ in no more bits than linked sets can."""
    for batch in batches:
        a, b, na, nb, xa, xb = (batch.column(i).to_pylist() for i in range(6))
        kept = []
        for i in range(len(a)):
            x, y = np.frombuffer(xa[i], np.uint64), np.frombuffer(xb[i], np.uint64)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            overlap = -(-NUM * (na[i] + nb[i]) // (NUM + DEN))
            kept.append(int(np.bitwise_count(x ^ y).sum()) <= na[i] + nb[i] - 2 * overlap)
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _exact(width: int):
    """Decide pairs on the whole sets of their texts."""
    secret = wb.KEY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def sets(ids: np.ndarray, texts: pa.Array) -> None:
            nonlocal held
            ids = np.asarray(ids)
            _, at = np.unique(ids, return_index=True)
            at = [i for i in at.tolist() if int(ids[i]) not in known]
            if at:
                part = pa.RecordBatch.from_arrays([pa.array(ids[at]), texts.take(pa.array(at))], names=["doc_id", "text"])
                for block in wb.blocks(iter([part])):
                    values, first = distinct_shingles(block, width, secret)
                    for k, d in enumerate(block.column("doc_id").tolist()):
                        known[d] = values[first[k] : first[k + 1]].copy()
                        held += known[d].nbytes

        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                if held > SETS_BYTES:
                    known.clear()
                    held = 0
                sets(a, part.column("text_a"))
                sets(b, part.column("text_b"))
                shared = np.array([len(np.intersect1d(known[x], known[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                union = np.array([len(known[x]) + len(known[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]) - shared
                yield part.select(["a", "b"]).filter(pa.array(DEN * shared >= NUM * union))

    return run


def choose_boundary(list_length: float) -> int:
    """The largest size whose subsets of two are no more than the entries of the lists it would scan."""
    x = 0
    for n in range(1, int(16 * list_length) + 64):  # beyond it subsets, of a tenth of n and more, are always dearer
        p = min(n, n - least_overlap(n) + 2)
        if p * (p - 1) / 2 <= (n - least_overlap(n) + 1) * list_length:
            x = n
    return x


def links(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of all documents, classes of equal sets, components of class representatives).

    ``docs`` has doc_id and text (see ``wordblock.doc_text``), and no id twice.
    """
    spark = docs.sparkSession
    signed = wb.keep(docs.mapInArrow(_signatures(width), "doc_id long, n long, sig_a long, sig_b long"), "signatures")
    classes = signed.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"))
    classes = wb.keep(classes, "classes")
    own = wb.keep(docs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text"), "own")
    wb.release(spark)

    often = wb.keep(own.mapInArrow(_often(width), "key long, n long, total long, repeats long"), "often")
    seen = often.where("total > 0").agg(F.count("*"), F.sum("total"), F.sum("repeats")).first()
    length = 1 + (seen[2] or 0) / (seen[1] or 1) * (seen[0] or 0)
    boundary = choose_boundary(min(length, 1 + ROUNDS))
    # CELLS bytes, whatever the input
    shared = spark.sparkContext.broadcast(_levels(often))

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen[1] or 0) // RANGE_SHINGLES))
    hits = wb.keep(own.mapInArrow(_entries(width, shared, boundary, ranges), _ENTRIES).groupBy("grp").applyInArrow(_shared, _HITS), "hits")
    wb.forget(often)
    del often
    wb.release(spark)

    texts = wb.keep(own.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    wb.forget(own)
    bits = wb.keep(texts.mapInArrow(_bitmaps(width), "doc_id long, n long, bits binary, " + ", ".join(f"{c} long" for c in _small())), "bitmaps")
    del own
    wb.release(spark)

    found, stars, table = None, None, hits
    for turn in range(ROUNDS):
        hits, table = _mixed(table, stars)
        order = {0: F.col("doc_id"), 1: -F.col("doc_id")}.get(turn, F.xxhash64("doc_id", F.lit(turn)))
        pivots = hits.groupBy("key").agg(F.min(F.struct(order.alias("o"), "doc_id", "part")).alias("p")).select("key", F.col("p.doc_id").alias("pivot"), F.col("p.part").alias("of"))
        met = hits.join(pivots, "key").where("part <> of").groupBy("doc_id", "pivot").agg(F.count("*").alias("lists"))
        one = met.groupBy("doc_id").agg(F.max(F.struct("lists", "pivot")).alias("m")).select(F.col("doc_id").alias("a"), F.col("m.pivot").alias("b"))
        more = _verified(texts, bits, one, width)
        if more.isEmpty():
            break
        both = more if found is None else wb.keep(found.union(more), "found")
        if found is not None:
            wb.forget(found, more)
        old, found, stars = stars, both, components(both)
        wb.forget(old)
        del pivots, met, one
        wb.release(spark)

    hits, table = _mixed(table, stars)
    lists = _listed(hits, bits)
    more = _verified(texts, bits, _pairs(lists).distinct(), width)
    out = components(more if found is None else found.union(more))
    wb.forget(table, lists, bits, texts, found, more, stars)
    return signed, classes, out


def _listed(hits: DataFrame, bits: DataFrame) -> DataFrame:
    """Entries of different lists, with the small bitmaps of their documents, their documents' first lists and those of them before the entry's own.

    Alike documents share hundreds of lists with the same members. They say no more than one of them,
    which is told by sums of the members' hashes under two seeds of this call.
    """
    sums = [F.sum(F.xxhash64("doc_id", F.lit(secrets.randbits(63))).cast("decimal(38,0)")).alias(c) for c in ("u", "v")]
    one = hits.groupBy("key").agg(F.count("*").alias("c"), *sums).groupBy("c", "u", "v").agg(F.min("key").alias("key")).select("key")
    kept = wb.keep(hits.join(one, "key", "left_semi"), "different")
    firsts = kept.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST).alias("firsts"))
    out = kept.join(firsts, "doc_id").join(bits.select("doc_id", *_small()), "doc_id").withColumn("before", F.filter("firsts", lambda k: k < F.col("key")))
    out = wb.keep(out, "lists")
    wb.forget(kept)
    return out


def _pairs(lists: DataFrame) -> DataFrame:
    """Pairs of different components that one list has and that may link, most of them once however many lists they share."""
    x, y = lists.alias("x"), lists.alias("y")
    differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in _small())
    return (
        x.join(y, F.col("x.key") == F.col("y.key"))
        .where("x.doc_id < y.doc_id AND x.part <> y.part")
        .where(f"{DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n)")
        # behind a shared element no more is left than the shorter rest
        .where(f"x.place < 0 OR ({NUM} + {DEN}) * (least(x.place, y.place) + least(x.n - x.place, y.n - y.place)) >= {NUM} * (x.n + y.n)")
        # sets differ in as many elements at least as their parity bitmaps in bits
        .where(f"{differ} <= x.n + y.n - 2 * (({NUM} * (x.n + y.n) + {NUM + DEN - 1}) div {NUM + DEN})")
        # a list before this one has the pair too
        .where("NOT arrays_overlap(x.before, y.firsts)")
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    )


def _mixed(table: DataFrame, stars: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The entries of lists that still hold several components, with the component of each document; and the table they are in."""
    hits = table.select("key", "doc_id", "n", "place")
    if stars is None:
        return hits.withColumn("part", F.col("doc_id")), table
    marked = hits.join(stars.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    mixed = marked.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    out = wb.keep(marked.join(mixed, "key", "left_semi"), "mixed")
    wb.forget(table)
    return out, out


def _verified(texts: DataFrame, bits: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    a = bits.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    b = bits.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    near = pairs.join(a, "a").join(b, "b").where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)").select("a", "b", "na", "nb", "xa", "xb")
    near = wb.keep(near.mapInArrow(_within_bound, "a long, b long"), "near")
    both = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    with wb.row_by_row(texts.sparkSession, PAIRS):
        out = wb.keep(both.mapInArrow(_exact(width), "a long, b long").distinct(), "links")
    wb.forget(near)
    return out


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document."""
    docs = wb.doc_text(docs, id_col, text_col)
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    one = wb.keep(docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "one") if repeated else docs
    signed, classes, stars = links(one, width)
    of_class = classes.join(stars.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "sig_a", "sig_b", "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.join(of_class, ["n", "sig_a", "sig_b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    return docs.select("doc_id").join(out, "doc_id") if repeated else out

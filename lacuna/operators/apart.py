"""Surrogates that no two entities share: a dictionary of ranks, and a keyed permutation of each kind's names.

Picking a surrogate by a hash alone gives two people one name now and then. Here each different entity
of the corpus (type and normalised text, known only by its keyed digest) has a rank of its own within its type, and
a keyed Feistel network with cycle walking takes ranks to places in the space of surrogates, one to one. Ranks beyond
the space go round it again with a number added, so surrogates never run out and never meet.

Ranks are given without a global sort: digests are spread evenly, so their first digits are buckets of
equal size, numbered from the sums of those before. ``dictionary(.., known=..)`` goes on behind the ranks of an earlier
run, so entities keep their surrogates as a corpus grows.

Defined cases: a null text has no spans and stays null; notes need ids that are unique and not null, others stop the job; repeated
texts share a surrogate; an empty table gives an empty result; kinds without a space of their own (dates,
postcodes, ages, shaped numbers) are replaced as by ``redact.surrogate``; an entity whose text is its own surrogate has a 1 added.
"""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.redact import _CARE, _FIRST, _KINDS, _LAST, _ROADS, _pick, keyed_udf, redact, surrogate

#: Buckets of a type's digests (three hex digits), so a count for each is a table of 4,096 rows a type at most.
_DIGITS = 3
#: Entities with more than one in ``HOT`` of all spans are looked up in a broadcast table, of fewer than ``HOT`` rows.
HOT = 10_000
ROUNDS = 8

_F, _L, _R, _K, _C = (len(x) for x in (_FIRST, _LAST, _ROADS, _KINDS, _CARE))


def _part(n: Column, by: int, size: int) -> Column:
    return F.floor(n / by) % size


def _full_name(n: Column, sep: str = " ") -> Column:
    return F.concat(_pick(_FIRST, n), F.lit(sep), _pick(_FIRST, n, _F), F.lit(sep), _pick(_LAST, n, _F * _F), F.lit("-"), _pick(_LAST, n, _F * _F * _L))


def _again(c: Column, before: str, after: str = "") -> Column:
    """What tells the rounds through a space apart; nothing in the first."""
    return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit(before), c, F.lit(after)))


#: For each kind the size of its space and (place, number of the round or "") -> surrogate, different for different arguments.
SPACES = {
    "PERSON": (_F * _F * _L * _L, lambda n, c: F.concat(_full_name(n), _again(c, " "))),
    "PHONE": (9000, lambda n, c: F.concat(F.lit("021 555 "), (n + 1000).cast("string"), _again(c, " ext "))),
    "EMAIL": (_F * _F * _L * _L, lambda n, c: F.concat(F.lower(_full_name(n, ".")), _again(c, "+"), F.lit("@example.com"))),
    "URL": (1 << 24, lambda n, c: F.concat(F.lit("https://www.example.org/"), F.lower(F.hex(n)), _again(c, "/"))),
    # the range of IPv6 addresses kept for examples
    "IP": (1 << 32, lambda n, c: F.concat(F.lit("2001:db8:"), F.when(c == "", F.lit("0")).otherwise(c), F.lit("::"), F.lower(F.hex(_part(n, 1 << 16, 1 << 16))), F.lit(":"), F.lower(F.hex(n % (1 << 16))))),
    "LOCATION": (9999 * _R * _K, lambda n, c: F.concat(_again(c, "Unit ", ", "), (_part(n, _R * _K, 9999) + 1).cast("string"), F.lit(" "), _pick(_ROADS, n), F.lit(" "), _pick(_KINDS, n, _R))),
    "ORG": (_R * _L * _L * _C, lambda n, c: F.concat(_pick(_ROADS, n), F.lit(" "), _pick(_LAST, n, _R), F.lit("-"), _pick(_LAST, n, _R * _L), F.lit(" "), _pick(_CARE, n, _R * _L * _L), _again(c, " "))),
}


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(key | 1)
    return x ^ x >> np.uint64(32)


def permuted(ranks: np.ndarray, size: int, key: bytes) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, at ``ranks``: a balanced Feistel network, walked on while it leaves the range.

    The network's range is less than four times ``size``, so a walk has less than four steps on average.
    """
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hmac.new(key, f"{size}:{i}".encode(), hashlib.sha256).digest()[:8], "little") for i in range(ROUNDS)]
    out = ranks.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ _mixed(right, k) & low
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _places(key: str):
    """(kind, rank) -> place in the kind's space, plus the size for each round before; the key stays out of the plan."""
    sizes = {k: n for k, (n, _) in SPACES.items()}

    @F.pandas_udf("long")
    def of(kind: pd.Series, rank: pd.Series) -> pd.Series:
        out = rank.to_numpy(np.int64, na_value=-1).copy()
        for k, n in sizes.items():
            at = np.flatnonzero((kind == k).to_numpy() & (out >= 0))
            out[at] += permuted(out[at] % n, n, f"{key}\0{k}".encode()) - out[at] % n
        return pd.Series(out).where(out >= 0, None).astype("Int64")

    return of


def surrogate_at(kind: Column, place: Column, text: Column) -> Column:
    """The surrogate of a place, for kinds with a space."""
    out = F.lit(None).cast("string")
    for k, (size, make) in SPACES.items():
        n, turn = place % size, F.floor(place / size)
        first = make(n, F.when(turn == 0, F.lit("")).otherwise((turn + 1).cast("string")))
        out = F.when(kind == k, F.when((turn == 0) & (first == text), make(n, F.lit("1"))).otherwise(first)).otherwise(out)
    return out


def entities(found: DataFrame, key: str, id_col: str = "note_id", spans_col: str = "spans") -> DataFrame:
    """(id, at, type, digest, text): one row for each span."""
    spans = F.col(spans_col)
    digests = keyed_udf(key)(F.transform(spans, lambda s: s["type"]), F.transform(spans, lambda s: s["text"]))
    ident = F.when(F.col(id_col).isNull(), F.raise_error(F.lit("a note without an id"))).otherwise(F.col(id_col))
    rows = found.select(ident.alias("id"), F.posexplode(F.arrays_zip(spans.alias("s"), digests.alias("d"))).alias("at", "z"))
    return rows.select("id", "at", F.col("z.s.type").alias("type"), F.col("z.d").alias("digest"), F.col("z.s.text").alias("text"))


def dictionary(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(type, digest, rank, n) of each different entity of ``rows`` that has a space, and of those of ``known``; n spans in ``rows``."""
    seen = rows.where(F.col("type").isin(*SPACES)).groupBy("type", "digest").agg(F.count("*").alias("n"))
    if known is not None:
        old = known.select("type", "digest", "rank")
        seen = seen.join(old, ["type", "digest"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
        # one row for each type
        begin = old.groupBy("type").agg((F.max("rank") + 1).alias("begin"))
    else:
        seen = seen.withColumn("rank", F.lit(None).cast("long"))
    seen = seen.withColumn("bucket", F.left("digest", F.lit(_DIGITS)))
    new = seen.where("rank is null")
    sums = new.groupBy("type", "bucket").count()
    sums = sums.select("type", "bucket", (F.sum("count").over(Window.partitionBy("type").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("type", "bucket").orderBy("digest")) - 1
    # 4,096 rows for each type with a space at most
    new = new.withColumn("within", within).join(F.broadcast(sums), ["type", "bucket"])
    if known is not None:
        new = new.join(F.broadcast(begin), "type", "left").withColumn("before", F.col("before") + F.coalesce("begin", F.lit(0)))
    new = new.select("type", "digest", (F.col("before") + F.col("within")).cast("long").alias("rank"), "n")
    return new if known is None else new.union(seen.where("rank is not null").select("type", "digest", "rank", "n"))


def _ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows with their entity's rank. Frequent entities are looked up apart, so no task gets all spans of one."""
    total = int(ranks.agg(F.sum("n")).first()[0] or 0)
    # fewer than HOT rows: each has more than a HOTth of all spans
    hot = ranks.where(F.col("n") * HOT > total).select("type", "digest", F.col("rank").alias("hot"))
    rows = rows.join(F.broadcast(hot), ["type", "digest"], "left")
    # frequent ones, and kinds without a space, have a key that is found nowhere and spreads them
    mine = F.col("hot").isNull() & F.col("type").isin(*SPACES)
    rows = rows.withColumn("key", F.when(mine, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "at").cast("string"))))
    rare = ranks.select(F.col("type").alias("kind"), F.col("digest").alias("key"), "rank")
    # as many as there are entities: the planner takes a table made of spans for far smaller than it is, so it must not choose
    rows = rows.join(rare.hint("merge"), (F.col("type") == F.col("kind")) & (rows["key"] == rare["key"]), "left")
    return rows.select("id", "at", "type", "digest", "text", F.coalesce("hot", "rank").alias("rank"))


def surrogates(rows: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    """(id, at, type, text, surrogate) of each row of ``entities``, by a ``dictionary`` that has them all."""
    placed = _ranked(rows, ranks).withColumn("place", _places(key)("type", "rank"))
    made = F.coalesce(surrogate_at(F.col("type"), F.col("place"), F.col("text")), surrogate(F.col("type"), F.col("text"), F.left("digest", F.lit(10))))
    return placed.select("id", "at", "type", "text", made.alias("surrogate"))


def redact_apart(found: DataFrame, key: str, known: DataFrame | None = None, id_col: str = "note_id", text_col: str = "text", spans_col: str = "spans") -> tuple[DataFrame, DataFrame]:
    """Notes with ``redacted_text``, and the dictionary to go on from.

    ``found`` (detected notes) is read three times, so it is cut from its lineage where the session has a
    checkpoint folder; else give a written table.
    """
    if not key:
        raise ValueError("surrogates need a key")
    if found.sparkSession.sparkContext.getCheckpointDir():
        found = found.checkpoint()
    rows = entities(found, key, id_col, spans_col)
    ranks = dictionary(rows, known)
    # the strings of one note, as many as its spans
    made = surrogates(rows, ranks, key).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("lacuna_made"))
    # the strings of all notes, which the planner would broadcast as well
    made = made.withColumnRenamed("id", "lacuna_id").hint("merge")
    out = found.join(made, found[id_col] == made["lacuna_id"], "left")
    strings = F.coalesce(F.transform("lacuna_made", lambda m: m["surrogate"]), F.array().cast("array<string>"))
    whole = F.size(strings) == F.greatest(F.size(spans_col), F.lit(0))
    strings = F.when(whole, strings).otherwise(F.raise_error(F.lit("several notes with one id")))
    return out.select(*[found[c] for c in found.columns], redact(F.col(text_col), F.col(spans_col), strings).alias("redacted_text")), ranks

"""Whitening of embeddings by TSQR.

Method: rows are centred with exact integer sums; each partition of the distinct rows is streamed into an
R factor by QR, and R factors are merged in a tree, ``FAN`` at a time. The singular values and right vectors of
the last R give the eigenvalues and components; no covariance is formed for them. (The check of the result,
``identity_error``, does sum the products of whitened rows, at most 16 x 16.)

An entry c counts as the whole number floor(64 c) + 1000000. The fit takes each distinct row once: equal rows
are brought together by an aggregate that first counts within tasks, so copies of one vector do not meet. Fitted
rows are written to the shared folder, as three passes read them. Driver and tasks hold sums (a number for each
dimension), factors of d x d, and the model of 16 x d; widths d over ``WIDTH`` are refused.

Rows whose vector is null, or holds a null, a NaN or an infinity, are left out; so are empty vectors, as they
have no components. Vectors of different lengths are fitted apart, each length on its own rows; more than ``WIDTHS``
lengths are refused. Components whose eigenvalue is zero to double precision (fewer distinct rows than
dimensions, constant dimensions) cannot be whitened and are left out: a table of equal rows gives an empty
result, as an empty table does. Repeated rows give equal rows each, null ids stay null. Entries beyond a long
are taken at its bounds, and a deviation beyond a long is null. Equal eigenvalues keep the order
that the decomposition gives; each component's largest entry is positive. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.llm.wordblock import forget, keep

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: R factors that are merged at a time.
FAN = 8
WIDTH, WIDTHS = 4096, 64
#: Rows that are worked on at a time.
ROWS = 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_FACTOR = "d int, part long, r array<double>"


@dataclass
class Model:
    """What whitens rows of one width; ``n`` rows with sums ``q * n + r``."""

    n: int
    q: np.ndarray
    r: np.ndarray
    vectors: np.ndarray | None = None  # a column for each component
    roots: np.ndarray | None = None  # square roots of eigenvalues
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.q) - self.r / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / self.roots

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None beyond a long."""
        low, high = x - self.q, float(np.max(np.abs(self.r), initial=0))
        if self.n * float(np.max(np.abs(low), initial=0)) + high < math.sqrt(2.0**62 / max(1, x.shape[1])):
            off = self.n * low - self.r
            return (off * off).sum(axis=1).tolist()
        r = [int(v) for v in self.r]
        sums = (sum((self.n * v - s) ** 2 for v, s in zip(row, r, strict=True)) for row in low.tolist())
        return [s if s < 1 << 63 else None for s in sums]


def whole_numbers(embeddings, id_col: str = "vec_id", vec_col: str = "embedding"):
    """(vec_id, x, d) of rows whose entries are all finite."""
    c = F.col(vec_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    rows = embeddings.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(c, lambda v: F.coalesce(finite(v), F.lit(False))))
    edge = float(1 << 62)
    whole = lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(edge)), F.lit(-edge))) + F.lit(SHIFT)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, whole).alias("x")).withColumn("d", F.size("x"))


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(width, rows as a matrix, the batch they are of), some rows at a time."""
    for batch in batches:
        widths = batch.column("d").to_numpy()
        for d in np.unique(widths).tolist():
            own = batch.filter(pa.array(widths == d))
            for at in range(0, own.num_rows, max(1, ROWS * 64 // d)):
                part = own.slice(at, max(1, ROWS * 64 // d))
                flat = part.column("x").flatten().to_numpy()
                yield d, flat.reshape(part.num_rows, d), part


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension of a task's rows, with their number; halves of a number are summed apart, so nothing overflows."""
    total: dict[int, list] = {}
    for d, x, _ in _by_width(batches):
        own = total.setdefault(d, [0, [0] * d])
        own[0] += len(x)
        high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
        own[1] = [s + (a << 32) + b for s, a, b in zip(own[1], high, low, strict=True)]
    rows = [{"d": d, "at": i, "n": n, "total": str(s)} for d, (n, sums) in total.items() for i, s in enumerate(sums)]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))


def _centres(fit) -> dict[int, Model]:
    """Exact sums over all fitted rows, by width."""
    parts = fit.select("x", "d").mapInArrow(_sums, "d int, at int, n long, total string")
    sums = parts.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    if (found := fit.agg(F.approx_count_distinct("d").alias("k"), F.max("d").alias("w")).first()).k > WIDTHS or (found.w or 0) > WIDTH:
        raise ValueError(f"vectors of more than {WIDTHS} lengths or more than {WIDTH} entries")
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for row in sums.collect():
        by.setdefault(row.d, {})[row["at"]] = row.n, int(row.total)
    out = {}
    for d, own in by.items():
        n = own[0][0]
        q, r = zip(*(divmod(own[i][1], n) for i in range(d)), strict=True)
        out[d] = Model(n, np.array(q, np.int64), np.array(r, np.int64))
    return out


def _factor(models: dict[int, Model]):
    """The R factor of a task's centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        factors: dict[int, np.ndarray] = {}
        for d, x, _ in _by_width(batches):
            own = models[d].centred(x)
            factors[d] = np.linalg.qr(np.vstack((factors[d], own)) if d in factors else own, mode="r")
        for d, r in factors.items():
            yield _factor_row(d, TaskContext.get().partitionId(), r)

    return run


def _factor_row(d: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("d", pa.int32()), ("part", pa.int64()), ("r", pa.list_(pa.float64()))])
    return pa.RecordBatch.from_pydict({"d": [d], "part": [part], "r": [r.ravel()]}, schema)


def _merged(key, table):
    """The R factor of up to ``FAN`` stacked ones."""
    d, part = (k.as_py() for k in key)
    stack = np.vstack([np.array(r).reshape(-1, d) for r in table.sort_by("part").column("r").to_pylist()])
    return pa.Table.from_batches([_factor_row(d, part, np.linalg.qr(stack, mode="r"))])


def _tree(factors):
    """One R factor for each width."""
    last = factors.agg(F.max("part")).first()[0] or 0
    while last:
        last //= FAN
        groups = factors.withColumn("group", F.floor(F.col("part") / FAN).cast("long")).groupBy("d", "group")
        factors = groups.applyInArrow(_merged, _FACTOR)
    return factors


def _components(key, table):
    """Singular values and up to 16 right vectors of the last R."""
    d = key[0].as_py()
    r = np.array(table.column("r")[0].as_py()).reshape(-1, d)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    top = vt[:COMPONENTS]
    return pa.table({"d": pa.array([d], pa.int32()), "s": pa.array([s.tolist()], pa.list_(pa.float64())), "v": pa.array([top.ravel().tolist()], pa.list_(pa.float64()))})


def _products(models: dict[int, Model]):
    """Sums of products of a task's whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x, _ in _by_width(batches):
            if models[d].vectors is not None:
                w = models[d].whitened(x)
                total[d] = total.get(d, 0) + np.vstack((w.T @ w, w.sum(axis=0)))
        rows = [{"d": d, "at": i, "total": v} for d, m in total.items() for i, v in enumerate(m.ravel().tolist())]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("at", pa.int32()), ("total", pa.float64())]))

    return run


def fit(embeddings, vec_col: str = "embedding", id_col: str = "vec_id") -> dict[int, Model]:
    """The model of each width, from the distinct rows."""
    rows = whole_numbers(embeddings, id_col, vec_col)
    distinct = keep(rows.groupBy("x").agg(F.first("d").alias("d")), "distinct")
    models = _centres(distinct)
    if models:
        factors = keep(distinct.select("x", "d").mapInArrow(_factor(models), _FACTOR), "factors")
        for row in _tree(factors).groupBy("d").applyInArrow(_components, "d int, s array<double>, v array<double>").collect():
            m, s = models[row.d], np.array(row.s)
            e, k = s * s / m.n, min(COMPONENTS, len(s))
            k = int((s[:k] > s[0] * max(m.n, row.d) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
            if k:
                v = np.array(row.v).reshape(-1, row.d)[:k].T
                v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
                m.vectors, m.roots, m.explained = np.ascontiguousarray(v), np.sqrt(e[:k]), e[:k] / e.sum()
        found = distinct.select("x", "d").mapInArrow(_products(models), "d int, at int, total double").groupBy("d", "at").agg(F.sum("total").alias("total")).collect()
        for d, m in models.items():
            if m.vectors is not None:
                k = len(m.roots)
                values = np.array([v for _, v in sorted((r["at"], r.total) for r in found if r.d == d)]).reshape(k + 1, k) / m.n
                m.identity_error = float(np.abs(values[:k] - np.outer(values[k], values[k]) - np.eye(k)).max())
        forget(factors)
    forget(distinct)
    return models


def _whiten(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, rows in _by_width(batches):
            m = models.get(d)
            if m is None or m.vectors is None:
                continue
            k, count = len(m.roots), len(x)
            each = lambda a: a.take(pa.array(np.repeat(np.arange(count), k)))  # noqa: B023, E731
            cols = [
                each(rows.column("vec_id")),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                pa.array(np.full(count * k, m.n, np.int64)),
                each(pa.array(m.deviations(x), pa.int64())),
                pa.array(m.whitened(x).ravel()),
                pa.array(np.tile(m.explained, count)),
                pa.array(np.full(count * k, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def whiten(embeddings, id_col: str = "vec_id", vec_col: str = "embedding"):
    """Whitened rows, a row for each component up to 16."""
    models = fit(embeddings, vec_col, id_col)
    return whole_numbers(embeddings, id_col, vec_col).mapInArrow(_whiten(models), SCHEMA)

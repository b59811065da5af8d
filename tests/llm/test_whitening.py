"""Whitening against eigenvectors of the covariance and exact integer arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import whitening as wh


def vectors(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    return df.withColumns({"x": F.lit("x"), "d": F.lit(1), "n": F.lit(None).cast("int"), "part": F.lit(2)})


def expected(rows):
    """{width: (n, S, eigenvalues, vectors, {vec_id: x})} by the covariance itself."""
    out = {}
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for d in {len(v) for _, v in usable}:
        own = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for i, v in usable if len(v) == d]
        fit = np.array(sorted({x for _, x in own}), np.int64)
        total = fit.sum(axis=0)
        c = fit - total / len(fit)
        e, q = np.linalg.eigh(c.T @ c / len(fit))
        out[d] = len(fit), total, e[::-1], q[:, ::-1], own
    return out


def compare(got, rows):
    want, seen = expected(rows), 0
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for d, (n, total, e, q, own) in want.items():
        k = min(16, int((e > e[0] * 1e-20 * max(n, d)).sum())) if e[0] > 0 else 0
        for j in range(k):
            if e[j] < 1e-9 * e[0]:
                continue
            sign = None
            for i, x in own:
                for r in by[i, j + 1]:
                    if r.n != n:
                        continue
                    exact = sum((n * a - int(s)) ** 2 for a, s in zip(x, total.tolist()))
                    assert r.deviation == (exact if exact < 1 << 63 else None)
                    w = float((np.array(x) - total / n) @ q[:, j] / math.sqrt(e[j]))
                    if sign is None and abs(w) > 1e-6:
                        sign = math.copysign(1, w * r.whitened)
                    assert abs(r.whitened * (sign or 1) - w) < 1e-6
                    assert abs(r.explained / (e[j] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
                    seen += 1
    return seen


def some(n=300, d=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=d) * np.arange(1, d + 1)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    return rows + [(2000, None), (2001, [None] * d), (2002, [math.nan] * d), (2003, [math.inf, *[0.0] * (d - 1)]), (2004, []), (None, rows[3][1])]


@pytest.mark.parametrize("fan", [wh.FAN, 2])
def test_against_the_covariance(spark, monkeypatch, fan):
    monkeypatch.setattr(wh, "FAN", fan)
    rows = some()
    df = vectors(spark, rows, 9)
    got = wh.whiten(df).collect()
    assert len(got) == 501 * 16 and {r.component for r in got} == {*range(1, 17)}
    assert compare(got, rows) == 501 * 16
    assert len({r.identity_error for r in got}) == 1


def test_lengths_are_fitted_apart_and_few_rows_have_fewer_components(spark):
    rows = [*some(40, 5), *((5000 + i, [float(i), float(-i), 3.0]) for i in range(4)), (6000, [1.0] * 7)]
    got = wh.whiten(vectors(spark, rows)).collect()
    count = {}
    for r in got:
        count[r.vec_id] = count.get(r.vec_id, 0) + 1
    assert count[0] == 5 and count[5001] == 1 and 6000 not in count and compare(got, rows)


def test_equal_rows_and_no_rows(spark):
    assert wh.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert wh.whiten(vectors(spark, [])).count() == 0


def test_large_entries(spark):
    rows = [(i, [float(10.0 ** (i % 37)), float(i)]) for i in range(60)]
    got = wh.whiten(vectors(spark, rows)).collect()
    assert {r.vec_id for r in got} == {*range(60)} and all(math.isfinite(r.whitened) for r in got)
    assert any(r.deviation is None for r in got)


def test_wide_or_many_lengths_are_refused(spark, monkeypatch):
    monkeypatch.setattr(wh, "WIDTH", 3)
    with pytest.raises(ValueError, match="more than 3 entries"):
        wh.whiten(vectors(spark, some(9, 4)))


def test_query_over_its_table(spark):
    from lacuna.llm.queries import op11_tsqr_whitening

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op11_tsqr_whitening(spark, sf).collect()
    assert compare(got, rows) == len(got) == 16 * len(rows)

"""What the two classifiers share: the fold that may be learnt from, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb


def fold(id_col: str = "doc_id", parts: int = 3):
    """crc32 of the id as text, modulo ``parts``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0))


def training(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: int = 1) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``rows`` rows of each label outside the held-out fold, and how many have each label.

    The rows are the first by a hash of their ids, so they are the same at each run. Their ids are a bounded
    table, so it is broadcast and only these documents are shuffled. One label for each id; null labels are dropped. Of
    rows with one id, however many, the text of the smallest hash counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(fold() != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    some = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (1, 0)]
    found = docs.join(F.broadcast(some[0].union(some[1])), "doc_id").select("doc_id", "text", "label")
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("r")).select("doc_id", "r.text", "r.label")
    return wb.keep(found, "labelled"), {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}


def weights(y: np.ndarray, count: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's labels the shares that they have among all labelled rows."""
    out = np.asarray(count, float).copy()
    for k in (0, 1):
        n = out[y == k].sum()
        if n:
            out[y == k] *= totals.get(k, 0) / n
    return out / max(out.mean(), 1e-9) if len(out) else out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Coefficients (the last is the intercept) by Newton steps. One class only: its smoothed share."""
    weight = np.ones(len(y)) if weight is None else weight
    design = np.column_stack((x, np.ones(len(y))))
    beta = np.zeros(design.shape[1])
    total, ones = weight.sum(), (weight * y).sum()
    if total == 0 or ones in (0, total):
        beta[-1] = np.log((ones + 0.5) / (total - ones + 0.5))
        return beta
    scale = np.maximum(np.abs(design).max(0), 1e-9)
    design = design / scale

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (b @ b) / 2)

    now = loss(beta)
    for _ in range(steps):
        p = sigmoid(design @ beta)
        grad = design.T @ (weight * (y - p)) - ridge * beta
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge * np.eye(len(beta))
        step, part = np.linalg.solve(hess, grad), 1.0
        while part > 1e-6 and (then := loss(beta + part * step)) > now:  # never uphill
            part /= 2
        if part <= 1e-6:
            break
        beta, done, now = beta + part * step, now - then < 1e-9 * (1 + now), then
        if done:
            break
    return beta / scale


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

"""Toxic passages: maximum-scoring segments over token log-odds.

* Half of the labelled rows give token counts. Tokens are counted once for each text, and once for the same word
  before them, so that texts which repeat themselves and copies of texts weigh no more. The counts
  give log-odds under an informative Dirichlet prior: of each token ``PRIOR`` times its count in both
  together, and ``FLAT`` on top. Tokens whose log-odds lie ``Z`` standard errors above 0 keep them as
  scores; the rest of all tokens share one score below 0, the log-odds of their sum.
* A linear-time scan finds all maximal-scoring segments of a text: each token is pushed and popped
  once, and each candidate knows the nearest one before it that starts lower. Tokens between scoring
  ones only add up, so the scan steps from one scoring token to the next.
* The largest segment score S of a clean text of m tokens follows an extreme-value law: P(S <= s) =
  exp(-K m exp(-L s)). K and L are fitted by maximum likelihood to clean texts of the other half,
  those without a segment counting as S <= 0. A segment then has E = K m exp(-L S) like it by chance.
* The segments of a text are aggregated to x = log(sum(exp(L S))) - log(K m), and a logistic fit on
  the other half, weighted to the labels' shares, turns x into a probability.

Words are runs of [0-9a-z] and characters beyond ASCII, A-Z lowered. Everything is learnt from at most
``SAMPLE_ROWS`` training rows of each label, which bounds the tokens that a model can have.

Defined cases: a row without an id is left out; null or empty texts have no segment and x = ``FLOOR``; without labels all scores are
0.5; repeated rows score alike; of tokens with equal scores each keeps its own place, and segments of equal score the shorter extent;
an empty table gives an empty result; extra columns are ignored; a very long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import wordblock as wb
from lacuna.llm.labelled import fold, logistic, sigmoid, training, weights

PRIOR, FLAT, Z, SAMPLE_ROWS = 0.001, 0.25, 2.5, 8000
FLOOR, CEILING = -25.0, 40.0
#: A passage is significant if fewer than so many like it are expected in a clean text of that length.
SIGNIFICANT = 0.01


@dataclass
class ToxicModel:
    tokens: np.ndarray
    scores: np.ndarray
    rest: float
    #: Of the extreme-value law.
    lam: float = 1.0
    k: float = 1.0
    beta: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def token_scores(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of scoring tokens, and their scores."""
        if not len(self.tokens) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0)
        k = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        at = np.flatnonzero(self.tokens[k] == h)
        return at, self.scores[k[at]]

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int) -> float:
        """x of a text; one without a segment has a sum of 1."""
        if not tokens:
            return FLOOR
        s = self.lam * np.array([x[2] for x in segments] or [0.0])
        top = s.max()
        return float(np.clip(top + np.log(np.exp(s - top).sum()) - np.log(self.k * tokens), FLOOR, CEILING))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x * self.beta[0] + self.beta[1])


def maximal_segments(at: list[int], scores: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) where tokens at ``at`` score above 0 and all others ``rest`` < 0.

    The stack holds candidates with the running sums to their left and right ends, and the place of the
    nearest candidate below each whose left sum is lower.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for place, s in zip(at, scores, strict=True):
        total += rest * (place - before - 1)
        left, right = total, total + s
        total, before, first = right, place, place
        k = len(stack) - 1
        while k >= 0 and stack[k][2] >= left:  # those between start no lower than this one
            k = stack[k][4]
        while k >= 0 and stack[k][3] < right:
            first, left, below = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = below
        stack.append((first, place, left, right, k))
    return [(a, b, r - le) for a, b, le, r, _ in stack]


def extreme_value(tokens: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(L, K) of greatest likelihood for the largest segment scores of texts; 0 where there is no segment."""
    has = best > 0
    n = int(has.sum())
    if n < 10:
        return 1.0, 1.0
    m, total = tokens.astype(float), float(best[has].sum())
    k = lambda lam: n / (m * np.exp(-lam * best)).sum()  # noqa: E731  the best K for an L
    value = lambda lam: n * np.log(lam) + n * np.log(k(lam)) - lam * total
    lo, hi = np.log(0.02), np.log(20.0)
    for _ in range(60):  # the profile has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (a, hi) if value(np.exp(a)) < value(np.exp(b)) else (lo, b)
    lam = float(np.exp((lo + hi) / 2))
    return lam, float(k(lam))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in wb.blocks(batches):
        words = block.words(lower=True, alnum=True)
        owner, h = wb.owner_of(words.first), words.hashes()
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[words.first[:-1][words.first[:-1] < len(h)]] = 0
        toxic = block.column("label")[owner] == 1
        order = np.lexsort((h, owner))  # stable: the first of a text's equal tokens leads
        h, before, toxic, owner = h[order], before[order], toxic[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(before[new].view(np.int64)), pa.array(toxic[new].astype(np.int32))], names=["token", "before", "toxic"])


def _scan(batches, model: ToxicModel):
    """Of each block: its documents' numbers of tokens, and their segments."""
    for block in wb.blocks(batches):
        words = block.words(lower=True, alnum=True)
        at, s = model.token_scores(words.hashes())
        cut = np.searchsorted(at, words.first)
        segments = [[] for _ in range(len(block))]
        for d in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[d], cut[d + 1]
            segments[d] = maximal_segments((at[a:b] - words.first[d]).tolist(), s[a:b].tolist(), model.rest)
        yield block, words.counts(), segments


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, segments in _scan(batches, shared.value):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([max((s for _, _, s in x), default=0.0) for x in segments], pa.float64())], names=["tokens", "best"])

    return run


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, tokens, segments in _scan(batches, shared.value):
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.evidence(s, int(m)) for s, m in zip(segments, tokens, strict=True)], pa.float64()), block.rows.column("label")], names=["x", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicModel:
    """Learn from the training fold."""
    spark = docs.sparkSession
    known, totals = training(docs, labels, label, SAMPLE_ROWS)
    counting = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    pairs = known.where(counting).repartition("doc_id").mapInArrow(_counts, "token long, before long, toxic int").groupBy("token", "before").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    counts = wb.keep(pairs.groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "tokens")
    nt, nc = (float(v or 0) for v in counts.agg(F.sum("t"), F.sum("c")).first())
    model = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -0.01)
    if nt and nc:
        prior = F.lit(PRIOR) * (F.col("t") + F.col("c")) + FLAT
        odds = lambda k, n: F.log((F.col(k) + prior) / (n - F.col(k) + PRIOR * (nt + nc)))
        z = counts.select("token", "t", "c", (odds("t", nt) - odds("c", nc)).alias("odds"), (F.col("t") + prior).alias("a"), (F.col("c") + prior).alias("b"))
        z = z.withColumn("z", F.col("odds") / F.sqrt(1 / F.col("a") + 1 / F.col("b"))).where(F.col("z") >= Z)
        top = z.toPandas()  # of the tokens of SAMPLE_ROWS texts of each label
        tokens = top["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        t, c = top["t"].sum(), top["c"].sum()
        rest = np.log(max(nt - t, 1) / nt) - np.log(max(nc - c, 1) / nc)
        model = ToxicModel(tokens[order], top["odds"].to_numpy(float)[order], float(min(rest, -0.005)))
    held = known.where(~counting).select("doc_id", "text", "label").repartition("doc_id")
    clean = held.where("label = 0").mapInArrow(_best(spark.sparkContext.broadcast(model)), "tokens long, best double").toPandas()  # SAMPLE_ROWS rows at most
    model.lam, model.k = extreme_value(clean["tokens"].to_numpy(), clean["best"].to_numpy(float))
    seen = held.mapInArrow(_evidence(spark.sparkContext.broadcast(model)), "x double, label int").toPandas()  # twice as many
    if len(seen):
        y = seen["label"].to_numpy(float)
        model.beta = logistic(seen[["x"]].to_numpy(), y, weights(y, np.ones(len(y)), totals), ridge=1e-3)
    return model


def _scored(shared, passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block, tokens, segments in _scan(batches, model):
            x = np.array([model.evidence(s, m) for s, m in zip(segments, tokens.tolist(), strict=True)], float)
            cols = [block.rows.column("doc_id"), pa.array(model.probability(x))]
            if passages:
                chance = lambda s, m: model.k * m * np.exp(-model.lam * s)
                rows = [[{"first": a, "last": b, "score": s, "expected": float(chance(s, m))} for a, b, s in segs if chance(s, m) < SIGNIFICANT] for segs, m in zip(segments, tokens.tolist(), strict=True)]
                cols.append(pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "passages"][: len(cols)])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.7, passages: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every document; scoring is map-only."""
    docs = wb.doc_text(docs, id_col, text_col)
    # tokens of a bounded sample
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    kind = "doc_id long, score double" + ", passages array<struct<first: int, last: int, score: double, expected: double>>" * passages
    out = docs.mapInArrow(_scored(shared, passages), kind)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["passages"] * passages)

"""Toxic passages by maximum-scoring segments.

Training counts, over labelled texts of the learning fold, how often each word and each word prefix
occurs in toxic and in clean texts.  The two classes share a Dirichlet prior at every level: a prefix
is shrunk towards its shorter prefix and a word towards its longest prefix, so a word that was never
seen still gets the log-odds of its stem.  Counts are summed by Spark into a hashed table of fixed
size (``BUCKETS`` a level); besides it the driver gets four numbers for each of the at most
``LABELLED_ROWS`` labelled texts.

Scoring turns a text into a sequence of token log-odds less a drift that makes the expected step
negative, finds all maximal scoring segments in one linear scan, and keeps those whose extreme-value
tail probability, ``1 - exp(-K n exp(-lambda s))``, is significant.  The calibrated statistic of the
best and of all significant segments goes through a logistic fit on cross-fitted training scores.
``DRIFT``, ``CEILING`` and ``PRIOR`` were chosen by log-loss over two folds of learning rows alone.

Null and empty texts have no segments and get the score of such texts.  Null labels are not learnt
from; with one class or no labels at all every text scores the base rate.  Of rows that share an id one
is learnt from; every row is scored alike, repeated ones too.  Segments of equal score are all kept.  A
very long text is one sequence and takes memory in proportion to its words.  Null ids and extra columns,
whatever their names, pass unharmed: one row out for each row in, none for an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import discard, filtered, labelled, mapped, residue, stored

BUCKETS = 1 << 19
PREFIX_BYTES = (3, 5, 7)
PRIOR = 8.0
DRIFT = 1.0
CEILING = 4.0
SIGNIFICANT = 0.05
SIZE = 0.1
STEP_WIDTH = 0.05
STEP_BINS = np.arange(-8.0, CEILING + 0.1, STEP_WIDTH)
LABELLED_ROWS = 40_000
THRESHOLD = 0.3
LEVELS = len(PREFIX_BYTES) + 1


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word at each level, with the word's text number, start and end."""
    first, last, doc = tc.words(data, offsets, tc.NON_LETTERS)
    hashes = tc.prefix_hashes(data, first, last, PREFIX_BYTES, tc.LOWER)
    hashes.append(tc.span_hashes(data, first, last, tc.LOWER))
    return [(h % np.uint64(BUCKETS)).astype(np.int64) for h in hashes], doc, first, last


def word_steps(counts: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Log-odds of every word against the base rate, shrunk level by level."""
    clean, toxic = counts[0, 0].sum(), counts[0, 1].sum()
    base = (toxic + 1.0) / (clean + toxic + 2.0)
    rate = np.full(len(levels[0]), base)
    for level, bucket in enumerate(levels):
        bad, good = counts[level, 1, bucket].astype(float), counts[level, 0, bucket].astype(float)
        rate = (bad + PRIOR * rate) / (bad + good + PRIOR)
    rate = np.minimum(rate, 1 - 1e-9)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    return np.minimum(odds, CEILING) - DRIFT


def segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one sequence, in linear time.

    The scan visits the positive steps alone; the steps between them enter as one sum.  A candidate
    whose left sum is not below the new one can never be extended again, so it leaves the stack for
    good unless a later segment swallows it.
    """
    above = np.flatnonzero(steps > 0)
    if not len(above):
        return []
    total = np.concatenate([[0.0], np.cumsum(steps)])
    stack: list[tuple[float, float, int, int, int]] = []  # sums before and after, start, end, finished before it
    done: list[tuple[int, int, float]] = []
    for k, left, right in zip(above.tolist(), total[above].tolist(), total[above + 1].tolist(), strict=True):
        start = k
        while True:
            while stack and stack[-1][0] >= left:
                b, r, s, e, _ = stack.pop()
                done.append((s, e, r - b))
            if not stack or stack[-1][1] >= right:
                stack.append((left, right, start, k + 1, len(done)))
                break
            left, _, start, _, mark = stack.pop()
            del done[mark:]
    return sorted(done + [(s, e, r - b) for b, r, s, e, _ in stack])


def tail(score: float, n: int, scale: float) -> float:
    """Probability that chance gives a segment of this score or more in ``n`` words."""
    return float(-np.expm1(-SIZE * max(n, 1) * np.exp(-scale * score)))


def evd_scale(steps: np.ndarray, times: np.ndarray) -> float:
    """Extreme-value scale: the positive root of ``mean(exp(scale * step)) = 1`` over clean steps."""
    if not times.sum() or (steps * times).sum() >= 0 or not times[steps > 0].sum():
        return 1.0

    def mean(scale: float) -> float:
        return float((np.exp(np.minimum(scale * steps, 50)) * times).sum() / times.sum())

    low, high = 1e-3, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if mean(mid) > 1 else (mid, high)
    return low


def statistics(scores: list[float], n: int, scale: float) -> tuple[float, float, float]:
    """Surprise of the best segment, of all significant ones, and the latter by length."""
    if not scores:
        return 0.0, 0.0, 0.0
    surprise = [-np.log(max(tail(s, n, scale), 1e-30)) for s in scores]
    strong = sum(x for x in surprise if x > -np.log(SIGNIFICANT))
    return float(np.log1p(max(surprise))), float(np.log1p(strong)), float(np.log1p(100.0 * strong / (n + 20.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression, by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    keep = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of (fold, class, level, bucket) of a partition's batches."""
    for batch in batches:
        group = batch.column(0).to_numpy(zero_copy_only=False) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = tc.utf8(batch.column(2))
        for i, j in tc.pieces(offsets):
            levels, doc, _, _ = units(*tc.text_slice(data, offsets, i, j))
            if not len(doc):
                continue
            key = np.concatenate([(group[i:j][doc] * LEVELS + k) * BUCKETS + b for k, b in enumerate(levels)])
            found, times = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["cell", "times"])


@dataclass
class Model:
    """Counts (level, class, bucket), extreme-value scale and calibration; of a fixed size."""

    counts: np.ndarray
    scale: float
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _cross_fitted(counts: np.ndarray, fold: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Steps of words under the counts of the other fold."""
    steps = np.zeros(len(fold))
    for f in (0, 1):
        at = fold == f
        steps[at] = word_steps(counts[1 - f], [b[at] for b in levels])
    return steps


def _pieces(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes, cross-fitted steps and where the steps of each text begin, of labelled batches piece by piece."""
    for batch in batches:
        fold, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, offsets = tc.utf8(batch.column(2))
        for i, j in tc.pieces(offsets):
            levels, doc, _, _ = units(*tc.text_slice(data, offsets, i, j))
            steps = _cross_fitted(counts, fold[i:j][doc], levels)
            yield y[i:j], steps, np.searchsorted(doc, np.arange(j - i + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = LABELLED_ROWS) -> Model:
    """Learn the counts, the extreme-value scale and the calibration."""
    rows = stored(labelled(docs, labels, label, bound))
    cells = mapped(rows, _count, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    counts = np.zeros((2, 2, LEVELS, BUCKETS), np.float32)
    counts.reshape(-1)[cells.column("cell").to_numpy()] = cells.column("times").to_numpy()
    counts = np.ascontiguousarray(counts.transpose(0, 2, 1, 3))  # fold, level, class, bucket
    both = counts.sum(0)
    del cells
    if not both[0, 0].sum() or not both[0, 1].sum():
        discard(rows)
        return Model(both, 1.0, np.array([30.0 if both[0, 1].sum() else -30.0, 0.0, 0.0, 0.0]))
    used = docs.sparkSession.sparkContext.broadcast(counts)

    def clean_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, steps, edge in _pieces(batches, used.value):
            clean = steps[np.repeat(y, np.diff(edge)) == 0]
            bins = np.clip((clean - STEP_BINS[0]) / STEP_WIDTH, 0, len(STEP_BINS) - 1).astype(int)
            found, times = np.unique(bins, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["bin", "times"])

    bins = np.zeros(len(STEP_BINS))
    for r in mapped(rows, clean_steps, "bin long, times long").groupBy("bin").agg(F.sum("times").alias("times")).collect():  # a row a bin
        bins[r["bin"]] = r["times"]
    scale = evd_scale(STEP_BINS, bins)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, steps, edge in _pieces(batches, used.value):
            found = [statistics([v for _, _, v in segments(steps[a:b])], int(b - a), scale) for a, b in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), *(pa.array(c, pa.float64()) for c in np.array(found).reshape(-1, 3).T)], ["y", "best", "strong", "dense"])

    seen = mapped(rows, measured, "y long, best double, strong double, dense double").toArrow()
    x = np.column_stack([seen.column(k).to_numpy() for k in ("best", "strong", "dense")])
    y = seen.column("y").to_numpy().astype(float)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))  # sums are then the same in any layout
    weights = logistic(x[order], y[order])
    used.unpersist()
    discard(rows)
    del counts, seen, x
    tc.release()
    return Model(both, scale, weights)


def score_texts(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and significant passages (byte start, byte end, segment score) of each text of one piece."""
    levels, doc, first, last = units(data, offsets)
    steps = word_steps(model.counts, levels)
    edge = np.searchsorted(doc, np.arange(len(offsets)))
    rows, spans = [], []
    for k in range(len(offsets) - 1):
        a, n = int(edge[k]), int(edge[k + 1] - edge[k])
        found = segments(steps[a : a + n])
        rows.append(statistics([v for _, _, v in found], n, model.scale))
        spans.append(
            [
                {"start": int(first[a + s] - offsets[k]), "end": int(last[a + e - 1] - offsets[k]), "score": v}
                for s, e, v in found
                if tail(v, n, model.scale) < SIGNIFICANT
            ]
        )
    return model.score(np.array(rows).reshape(-1, 3)), spans


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` of every row."""
    used = docs.sparkSession.sparkContext.broadcast(model)
    passages = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(batch.column(1))
            for i, j in tc.pieces(offsets):
                scores, spans = score_texts(*tc.text_slice(data, offsets, i, j), used.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(scores), pa.array(spans, passages)], ["doc_id", "score", "passages"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    scored = mapped(slim, run, "doc_id long, score double, passages array<struct<start: bigint, end: bigint, score: double>>")
    return scored.select(
        "doc_id", (residue("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages"
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    used = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> np.ndarray:
        data, offsets = tc.utf8(texts)
        scores = [score_texts(*tc.text_slice(data, offsets, i, j), used.value)[0] for i, j in tc.pieces(offsets)]
        return np.concatenate([*scores, np.zeros(0)]) < THRESHOLD

    return filtered(docs, "text", judge)

"""Quality classifier: a factorisation machine over words, structure and metadata.

A text's features are its hashed lower-cased words (log term frequency, normalised to length one) and
a few standardised measures: structure of words, lines and symbols, repetition, and the table's
``n_chars``.  Pairs of features interact through low-rank factors; the pairwise sum is computed in
linear time as half of ``(sum v x)**2 - sum (v x)**2`` for each factor.  The machine is fitted by
mini-batch AdaGrad on a bounded sample of labelled rows (``LABELLED_ROWS``, the smallest hashes of the
id outside the held-out fold); scoring reads every row.

At most ``LABELLED_ROWS`` texts, so at most that many times ``BUCKETS`` entries, reach the driver.  Training
is in a fixed order of a fixed seed over rows in order of their id's hash, one row for each id, so the
same rows in any layout give the same machine.

Null texts are empty; an empty text has its measures alone and gets a score as well.  A null
``n_chars``, or none at all, falls back to the text's length.  With no labels every score is 0.5.  Very long
texts are measured alone, in memory in proportion to their words.  Null ids, repeated rows and extra
columns, whatever their names, pass unharmed: one row out for each row in, none for an empty table; equal
texts of equal ``n_chars`` score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import labelled, mapped, residue

BUCKETS = 1 << 16
FACTORS = 8
LABELLED_ROWS = 6_000
EPOCHS = 8
RATE = 0.1
BATCH = 64
RIDGE = 1e-4
SEED = 11
THRESHOLD = 0.7


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_COUNTED = {
    "symbols": _class(b"#*$%&<>^~@\\{}[]_=+"),
    "bars": _class(b"|"),
    "bangs": _class(b"!?"),
    "stops": _class(b".,;:"),
    "digits": _class(b"0123456789"),
    "upper": _class(bytes(range(0x41, 0x5B))),
    "lower": _class(bytes(range(0x61, 0x7B))),
    "lines": _class(b"\n"),
}
MEASURES = 14


def measures(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray, doc: np.ndarray, hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Structure and metadata measures of each text."""
    n = len(offsets) - 1
    words = tc.per_text(doc, n).astype(float)
    at_least = np.maximum(words, 1.0)
    seen = {k: np.diff(np.searchsorted(np.flatnonzero(t[data]), offsets)).astype(float) for k, t in _COUNTED.items()}
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    keys = tc.within(hashes, doc)
    distinct = words - tc.per_text(doc[tc.earlier(keys)], n)
    rolled, inside = tc.grams(hashes, 3), tc.windows(doc, 3)
    hit = np.zeros(len(rolled), bool)
    hit[inside] = tc.repeated(tc.within(rolled[inside], doc[: len(rolled)][inside]))
    cased = np.maximum(seen["upper"] + seen["lower"], 1.0)
    columns = [
        np.log1p(words),
        np.log1p(n_chars),
        tc.per_text(doc, n, chars) / at_least,
        np.minimum(seen["symbols"] / at_least, 4.0),
        np.minimum(seen["bars"] / at_least, 2.0),
        np.minimum(seen["bangs"] / at_least, 3.0),
        np.minimum(seen["stops"] / at_least, 2.0),
        np.minimum(seen["digits"] / at_least, 4.0),
        seen["upper"] / cased,
        np.minimum(seen["lines"] / at_least, 1.0),
        distinct / at_least,
        tc.per_text(doc[same], n) / at_least,
        tc.per_text(doc[: len(rolled)][hit], n) / at_least,
        (words == 0).astype(float),
    ]
    return np.column_stack(columns)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, buckets and values of the words, and the dense measures."""
    n = len(offsets) - 1
    first, last, doc = tc.words(data, offsets)
    plain = tc.span_hashes(data, first, last)
    folded = tc.span_hashes(data, first, last, tc.LOWER)
    dense = measures(data, offsets, n_chars, doc, plain, tc.char_counts(data, first, last))
    cell, times = np.unique(doc * BUCKETS + (folded % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = cell // BUCKETS, (cell % BUCKETS).astype(np.int32)
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value**2, n))
    pointer = np.searchsorted(row, np.arange(n + 1))
    return pointer, bucket, (value / norm[row]).astype(np.float32), dense


@dataclass
class Machine:
    """Bias, linear weights, factors, and the scaling of the dense measures; of a fixed size."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def join(self, pointer: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, feature and value of every non-zero entry, measures included."""
        n = len(dense)
        scaled = np.clip((dense - self.mean) / self.spread, -4, 4) / 2
        row = np.concatenate([np.repeat(np.arange(n), np.diff(pointer)), np.repeat(np.arange(n), MEASURES)])
        index = np.concatenate([bucket.astype(np.int64), np.tile(BUCKETS + np.arange(MEASURES), n)])
        return row, index, np.concatenate([value, scaled.ravel()])

    def raw(self, n: int, row: np.ndarray, index: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, by the sum-of-squares identity, and the factor sums of each row."""
        sums, squares = np.zeros((n, FACTORS)), np.zeros(n)
        for f in range(FACTORS):
            vx = self.factors[index, f] * x
            sums[:, f] = np.bincount(row, vx, n)
            squares += np.bincount(row, vx * vx, n)
        return self.bias + np.bincount(row, self.linear[index] * x, n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, *parts: np.ndarray) -> np.ndarray:
        n = len(parts[3])
        return 1 / (1 + np.exp(-np.clip(self.raw(n, *self.join(*parts))[0], -30, 30)))


def train(pointer: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Machine:
    """Fit a machine by AdaGrad on mini-batches, in a fixed order of a fixed seed."""
    rng = np.random.default_rng(SEED)
    size = BUCKETS + MEASURES
    share = np.clip(y.mean(), 0.01, 0.99)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), dense.mean(0), dense.std(0) + 1e-6)
    grown, grown_v, grown_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            length = pointer[own + 1] - pointer[own]
            take = np.repeat(pointer[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            row, index, x = machine.join(np.concatenate([[0], np.cumsum(length)]), bucket[take], value[take], dense[own])
            raw, sums = machine.raw(len(own), row, index, x)
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]
            used, where = np.unique(index, return_inverse=True)
            gx = slope[row] * x
            g = np.bincount(where, gx, len(used)) / len(own) + RIDGE * machine.linear[used]
            grown[used] += g * g
            machine.linear[used] -= RATE * g / np.sqrt(grown[used])
            for f in range(FACTORS):
                v = machine.factors[index, f]
                gv = np.bincount(where, gx * (sums[row, f] - v * x), len(used)) / len(own) + RIDGE * machine.factors[used, f]
                grown_v[used, f] += gv * gv
                machine.factors[used, f] -= RATE * gv / np.sqrt(grown_v[used, f])
            grown_b += slope.mean() ** 2
            machine.bias -= RATE * slope.mean() / np.sqrt(grown_b)
    return machine


def _columns(batch: pa.RecordBatch, text: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = tc.utf8(batch.column(text))
    return data, offsets, batch.column(length).to_numpy(zero_copy_only=False).astype(float)


def _known_length(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    known = F.greatest(F.coalesce(size, F.char_length("text").cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select("doc_id", "text", known.alias("__n_chars"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED_ROWS) -> Machine | None:
    """Fit a machine on the labelled sample; None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, n_chars = _columns(batch, 2, 4)
            for i, j in tc.pieces(offsets):
                pointer, bucket, value, dense = features(*tc.text_slice(data, offsets, i, j), n_chars[i:j])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(3)[i:j],
                        batch.column(1)[i:j].cast(pa.int32()),
                        pa.ListArray.from_arrays(pa.array(pointer, pa.int32()), pa.array(bucket)),
                        pa.ListArray.from_arrays(pa.array(pointer, pa.int32()), pa.array(value)),
                        pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), MEASURES).cast(pa.list_(pa.float64())),
                    ],
                    ["rank", "y", "bucket", "value", "dense"],
                )

    rows = labelled(_known_length(docs), labels, label, bound, ("__n_chars",))
    got = mapped(rows, run, "rank long, y int, bucket array<int>, value array<float>, dense array<double>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    got = got.sort_by("rank").combine_chunks()
    lists = [got.column(k).combine_chunks() if got.column(k).num_chunks != 1 else got.column(k).chunk(0) for k in ("bucket", "value", "dense")]
    pointer = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]).astype(np.int64)
    bucket, value, dense = (x.flatten().to_numpy() for x in lists)
    return train(pointer, bucket, value, dense.reshape(-1, MEASURES), got.column("y").to_numpy().astype(float))


def quality(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    used = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, n_chars = _columns(batch, 1, 2)
            for i, j in tc.pieces(offsets):
                parts = features(*tc.text_slice(data, offsets, i, j), n_chars[i:j])
                score = used.value.score(*parts) if used.value else np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(score)], ["doc_id", "score"])

    slim = _known_length(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__n_chars")
    scored = mapped(slim, run, "doc_id long, score double")
    return scored.select("doc_id", (residue("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

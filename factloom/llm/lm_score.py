"""Stupid-backoff language-model scores, computed relationally.

Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  N-grams of all documents up to
``ORDER`` are counted in tables partitioned by hash.  A word scores ``c(n-gram) / c(its context)`` for the
longest n-gram ending in it that occurs at least ``MIN_COUNT`` times; each backoff step costs a factor
``ALPHA``; the last step is ``c(word) / N``.

Documents are dealt to batches of about ``BATCH_BYTES`` by a hash.  A batch's distinct n-grams are
exploded once, with their counts in the batch, and go to hash partitions, packed: one row for a batch
and a partition holds the sorted hashes as differences and the counts.  A partition adds up its table,
joins it to each row, and answers with the totals in the row's order, so no hash travels back.  The
batch then sums the logarithms for each document.  A very common n-gram has one entry a batch, not one
a document; a task holds a batch of texts, or a partition of about ``PARTITION_ENTRIES`` entries.

Rows number batches times partitions at most.  So that a packed row keeps many entries, and the volume
stays in proportion to the input, both sizes grow with the square root of what is above ``GROWS_FROM``
bytes: at 100 TB a batch has 320 MB of text and a partition 40 million entries.  Each batch has a task of
its own up to ``PLACED`` batches: its number is one that hash partitioning sends there.

A null or empty text has 0 words, score 0 and no mean.  Null ids and repeated rows are scored like any
other: one row out for each row in, none for an empty table.  A very long text is in one batch, which it
may fill alone.  N-grams of equal count score alike.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import WORD

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
BATCH_BYTES = 16 << 20
PARTITION_ENTRIES = 2_000_000
#: Bytes of text for each n-gram length and entry, for choosing the number of partitions.
BYTES_AN_ENTRY = 8
GROWS_FROM = 250_000_000_000
PLACED = 20_000


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]:
    """Hashes of all windows by length, which of them lie in one text, and the text number of each word."""
    data, offsets = tc.utf8(texts)
    hashes, docs = [], []
    for i, j in tc.pieces(offsets):
        part, bounds = tc.text_slice(data, offsets, i, j)
        first, last, doc = tc.words(part, bounds)
        hashes.append(tc.span_hashes(part, first, last, tc.LOWER))
        docs.append(doc + i)
    words, doc = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*docs, np.zeros(0, np.int64)])
    return [tc.grams(words, n) for n in range(1, order + 1)], [tc.windows(doc, n) for n in range(1, order + 1)], doc, len(offsets) - 1


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first; high planes that are zero are left out."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = 8 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(planes[:used]).tobytes()


def _unpack(packed: bytes, count: int) -> np.ndarray:
    """The integers that ``_pack`` was given."""
    planes = np.zeros((8, count), np.uint8)
    if count:
        own = np.frombuffer(packed, np.uint8).reshape(-1, count)
        planes[: len(own)] = own
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _edges(distinct: np.ndarray, partitions: int) -> np.ndarray:
    """Where each hash partition begins and ends among sorted hashes."""
    starts = np.array([((1 << 64) * k) // partitions for k in range(1, partitions)], np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, starts), [len(distinct)]])


def _distinct(grams: list[np.ndarray], inside: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all lengths, and their counts."""
    found = np.concatenate([g[i] for g, i in zip(grams, inside, strict=True)])
    found.sort()
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.diff(np.append(first, len(found)))


def _counter(order: int, partitions: int):
    """Distinct n-grams of a batch with their counts, a row for each hash partition."""

    def run(group: pa.Table) -> pa.Table:
        grams, inside, _, _ = _grams(group.column("text"), order)
        distinct, counts = _distinct(grams, inside)
        edges = _edges(distinct, partitions)
        rows = []
        for k in range(partitions):
            own = distinct[edges[k] : edges[k + 1]]
            if len(own):
                steps = np.diff(own, prepend=np.uint64(((1 << 64) * k) // partitions))
                rows.append((k, len(own), _pack(steps), _pack(counts[edges[k] : edges[k + 1]].astype(np.uint64))))
        part, size, hashes, times = zip(*rows, strict=True) if rows else ((),) * 4
        batch = np.full(len(rows), group.column("batch")[0].as_py(), np.int32)
        return pa.table({"batch": batch, "part": pa.array(part, pa.int32()), "size": pa.array(size, pa.int32()), "hashes": pa.array(hashes, pa.binary()), "times": pa.array(times, pa.binary())})

    return run


def _adder(group: pa.Table) -> pa.Table:
    """Totals of a hash partition, for each of its rows in the row's order."""
    sizes = group.column("size").to_numpy().astype(np.int64)
    hashes = [np.cumsum(_unpack(x.as_py(), n)) for x, n in zip(group.column("hashes"), sizes, strict=True)]
    times = np.concatenate([_unpack(x.as_py(), n) for x, n in zip(group.column("times"), sizes, strict=True)])
    _, where = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(where, times.astype(float))[where].astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    packed = [_pack(totals[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.table({"batch": group.column("batch"), "part": group.column("part"), "size": group.column("size"), "totals": pa.array(packed, pa.binary())})


def _scorer(order: int, alpha: float, least: int, words: int):
    """Scores of a batch's documents from the totals that returned to it, in a corpus of ``words`` words."""

    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams, inside, doc, size = _grams(texts.column("text"), order)
        distinct, _ = _distinct(grams, inside)
        parts = np.argsort(answers.column("part").to_numpy())
        sizes = answers.column("size").to_numpy()
        totals = [_unpack(answers.column("totals")[int(k)].as_py(), int(sizes[k])).astype(float) for k in parts]
        totals = np.concatenate([*totals, np.zeros(0)])
        context = np.full(len(doc) + 1, math.log(max(words, 1)))
        score = np.zeros(len(doc))
        for k in range(order):
            logs = np.full(len(doc) + 1, np.nan)
            at = inside[k].nonzero()[0]
            counts = totals[np.searchsorted(distinct, grams[k][at])]
            logs[at] = np.log(np.where(counts >= (least if k else 1), counts, np.nan))
            ends = np.arange(k, len(doc))  # words that end a window of this length
            gain = logs[ends - k] - context[ends - k]
            fits = inside[k][ends - k]
            seen = fits & ~np.isnan(gain)
            if k == 0:
                score[ends] = gain
            else:
                score[ends] = np.where(seen, gain, np.where(fits, score[ends] + math.log(alpha), score[ends]))
            context = logs
        del grams, inside, distinct, totals, context, logs, counts
        tc.release()
        tokens = np.bincount(doc, minlength=size)
        total = np.bincount(doc, score, size)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": tokens.astype(np.int64), "total": total.astype(float)})

    return run


def _murmur(numbers: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers, which decides the partition of a row."""
    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint32(n)) | (x >> np.uint32(32 - n))

    with np.errstate(over="ignore"):
        k = turned(numbers.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def batch_numbers(batches: int) -> np.ndarray:
    """A number for each batch; up to ``PLACED`` of them, hash partitioning sends each to another partition."""
    if batches > PLACED:
        return np.arange(batches, dtype=np.int32)
    size = 16 * batches
    while True:
        at, first = np.unique(_murmur(np.arange(size, dtype=np.int32)).astype(np.int64) % batches, return_index=True)
        if len(at) == batches:
            return first.astype(np.int32)
        size *= 2


def scores(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = MIN_COUNT, batch_bytes: int = BATCH_BYTES, partition_entries: int = PARTITION_ENTRIES
) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, words = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")), F.lit(0))).first()
    grown = max(1.0, math.sqrt(size / GROWS_FROM))
    # as many batches as tasks at least, so that small inputs use all cores
    batches = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (batch_bytes * grown)))
    partitions = max(1, math.ceil(size * order / BYTES_AN_ENTRY / (partition_entries * grown)))
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    batch = slot if batches > PLACED else F.element_at(F.lit(batch_numbers(batches)), slot + 1)
    dealt = slim.withColumn("batch", batch).repartition(min(batches, PLACED), "batch")
    counted = dealt.groupBy("batch").applyInArrow(_counter(order, partitions), "batch int, part int, size int, hashes binary, times binary")
    answers = counted.groupBy("part").applyInArrow(_adder, "batch int, part int, size int, totals binary")
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scorer(order, alpha, least, words), "doc_id long, n_tokens long, total double")
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("total") / F.col("n_tokens"), 6))
    return scored.select("doc_id", "n_tokens", F.round("total", 4).alias("log_score"), mean.alias("mean_log_score"))

"""Quality rules by repetition coverage.

For every whole text, rolling hashes of several n-gram lengths mark the words that lie in n-grams
found at least twice in the text; the share of characters of those words, and of lines equal to an
earlier line, decides.  Longer n-grams are only looked for where every shorter one repeats, so clean
texts cost one sort.

A null text has no words.  Fewer words than ``MIN_WORDS``, or more than half of the words inside
repeated 3-word windows, fails the base rules (so an empty text is rejected).  A share that equals its
limit passes.  A very long text is one piece and takes memory in proportion to its words.  Null ids,
repeated rows and extra columns, whatever their names, pass unharmed: only ``doc_id`` and ``text`` are read,
one row out for each row in, none for an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import filtered, mapped

MIN_WORDS = 50
BASE_WINDOW = 3
#: Share of word characters allowed inside repeated n-grams, by n-gram length.
COVERAGE_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Share of word characters allowed in lines equal to an earlier line.
LINE_CHARS_LIMIT = 0.30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in COVERAGE_LIMITS))


def _covered(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words that lie in a marked window of ``n`` words."""
    out = np.zeros(size, bool)
    for k in range(n):
        out[k : k + len(hit)] |= hit
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of one piece."""
    count = len(offsets) - 1
    first, last, doc = tc.words(data, offsets)
    hashes, chars = tc.span_hashes(data, first, last), tc.char_counts(data, first, last)
    out = {"n_words": tc.per_text(doc, count), "word_chars": tc.per_text(doc, count, chars)}
    symbols = np.flatnonzero(_SYMBOL[data])
    out["n_symbols"] = tc.per_text(np.searchsorted(offsets, symbols, "right") - 1, count)

    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, first)
    fresh = np.ones(len(first), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    row, row_doc = line[fresh], doc[fresh]
    edges = np.concatenate([[-1], breaks, [len(data)]])
    begin, end = np.maximum(edges[row] + 1, offsets[row_doc]), np.minimum(edges[row + 1], offsets[row_doc + 1])
    again = tc.earlier(tc.within(tc.span_hashes(data, begin, end), row_doc))
    out["n_dup_lines"] = tc.per_text(row_doc[again], count)
    of_line = np.cumsum(fresh) - 1
    out["dup_line_chars"] = tc.per_text(doc, count, chars * again[of_line]) if len(first) else np.zeros(count, np.int64)

    hit = np.zeros(0, bool)
    for n in (BASE_WINDOW, *COVERAGE_LIMITS):
        rolled = tc.grams(hashes, n)
        if n == BASE_WINDOW:
            look = np.flatnonzero(tc.windows(doc, n))
        else:
            look = np.flatnonzero(_inner(hit, len(rolled), n - shorter) & tc.windows(doc, n)) if len(rolled) else np.zeros(0, np.int64)
        hit = np.zeros(len(rolled), bool)
        hit[look] = tc.repeated(tc.within(rolled[look], doc[look]))
        shorter = n
        covered = _covered(hit, n, len(first))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = tc.per_text(doc[covered], count)
        else:
            out[f"dup_{n}gram_chars"] = tc.per_text(doc, count, chars * covered) if len(first) else np.zeros(count, np.int64)
    return out


def _inner(hit: np.ndarray, size: int, more: int) -> np.ndarray:
    """Windows all of whose shorter windows are marked."""
    out = np.ones(size, bool)
    for k in range(more + 1):
        out &= hit[k : k + size]
    return out


def repetition_measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(batch.column(1))
            for i, j in tc.pieces(offsets):
                found = measure(*tc.text_slice(data, offsets, i, j))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(found[k]) for k in FIELDS)], ["doc_id", *FIELDS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return mapped(slim, run, "doc_id long, " + ", ".join(f"{k} long" for k in FIELDS))


def verdicts(m: dict) -> tuple:
    """``base_failed`` and ``kept`` from the measures, of arrays or of columns alike."""
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
    passes = m["dup_line_chars"] <= m["word_chars"] * LINE_CHARS_LIMIT
    for n, limit in COVERAGE_LIMITS.items():
        passes = passes & (m[f"dup_{n}gram_chars"] <= m["word_chars"] * limit)
    return failed, ~failed & passes


def passing(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is ``kept``, with all their columns."""

    def judge(texts: pa.Array) -> np.ndarray:
        data, offsets = tc.utf8(texts)
        found = [verdicts(measure(*tc.text_slice(data, offsets, i, j)))[1] for i, j in tc.pieces(offsets)]
        return np.concatenate([*found, np.zeros(0, bool)])

    return filtered(docs, "text", judge)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures with ``base_failed`` and ``kept`` for every row."""
    m = repetition_measures(docs)
    failed, kept = verdicts({k: F.col(k) for k in FIELDS})
    return m.withColumn("base_failed", failed).withColumn("kept", kept)

"""Token counts: exact lengths of encoded texts, counted in Arrow batches.

Only lengths leave the function.  Texts are cut at white space, where the tokenizer is proved to begin
anew: a white-space character is a safe boundary if, for a set of probe strings around it, the counts of
both sides add up to the count of the whole; with none, texts are encoded whole.  Runs without white space
that are longer than a slice are cut between a sentence mark and an ideograph or kana, if that is as safe.
A text's count is the sum over its pieces; equal pieces are encoded once while they stay in a memo of
bounded bytes.  Pieces gather into batches of about equal bytes before they are encoded, and a long text
is handled in slices, so memory is bounded by the slice, the memo and the longest run without a boundary.

Null and empty texts have 0 bytes and 0 tokens; null ids, repeated rows and extra columns, whatever their
names, pass unharmed: only ``doc_id`` and ``text`` are read, one row out for each row in, none for an
empty table.  A text of exactly the limit is not over it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

BATCH_BYTES = 1 << 20
SLICE_CHARS = 1 << 18
MEMO_BYTES = 48 << 20
#: What an entry of the memo takes besides its piece.
ENTRY_BYTES = 120
_SPACES = " \n\t\r\x0b\x0c"
#: Sentence marks, each before an ideograph or kana.
_MARK = re.compile("(?<=[\u3002\uff01\uff1f\uff0c\uff1b\uff1a\u3001])(?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])")
_PROBES = ("a", "word", "A1", "it's", "'s", "x.", "...", "<|", "|>", "end<", "é", "e\u0301", "\u0301", "ß", "日本", "の", "が", "한", "✓", "👍🏽", "1,5", "_a", "ΑΣ", "Σ", "İ", "\u200d", "\ufeff", "ab  c")
_LOADED: dict[str, Counter] = {}


@dataclass
class Counter:
    """A tokenizer with its safe boundaries and a memo of piece lengths."""

    tokenizer: object
    spaces: str = ""
    marks: bool = False
    memo: dict[str, int] = field(default_factory=dict)
    held: int = 0

    def lengths(self, texts: list[str]) -> list[int]:
        """Encoded lengths of texts as they are."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [len(x) for x in encode(texts, add_special_tokens=False)]

    def safe(self, joint: str, lefts: tuple[str, ...], rights: tuple[str, ...]) -> bool:
        """Whether counts add up over a joint for all probes."""
        pairs = [(a, b) for a in lefts for b in rights]
        whole = self.lengths([a + joint + b for a, b in pairs])
        left, right = (dict(zip(p, self.lengths(list(p)), strict=True)) for p in (lefts, rights))
        return whole == [left[a] + right[b] for a, b in pairs]

    def learn(self, pieces: set[str], batch_bytes: int) -> None:
        """Encode pieces in batches of about equal bytes."""
        batch, size = [], 0
        for piece in pieces:
            batch.append(piece)
            size += _bytes(piece)
            if size >= batch_bytes:
                self.memo.update(zip(batch, self.lengths(batch), strict=True))
                self.held, batch, size = self.held + size + ENTRY_BYTES * len(batch), [], 0
        self.memo.update(zip(batch, self.lengths(batch), strict=True))
        self.held += size + ENTRY_BYTES * len(batch)


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def counter(path: str) -> Counter:
    """The tokenizer of a file, loaded once a worker, with what is safe to cut at."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        made = Counter(tokenizer)
        made.spaces = "".join(c for c in _SPACES if made.safe(c, _PROBES, _PROBES))
        made.marks = all(made.safe("", tuple(x + m for x in ("a", "日", "の", "。")), ("日", "の", "ガ", "か\u3099")) for m in "。！？，；：、")
        _LOADED[path] = made
    return _LOADED[path]


def slices(text: str, spaces: str = " ", marks: bool = False, size: int = SLICE_CHARS) -> Iterator[str]:
    """Slices of a text that end at a safe boundary; a run without one is never cut."""
    if len(text) <= size or not (spaces or marks):
        if text:
            yield text
        return
    bounds = [re.escape(c) for c in spaces] + ([_MARK.pattern] if marks else [])
    boundary, at = re.compile("|".join(bounds)), 0
    while at < len(text):
        met = boundary.search(text, at + size) if len(text) - at > size else None
        end = met.start() if met else len(text)
        yield text[at:end]
        at = max(met.end(), at + 1) if met else end


def count_tokens(texts: list[str | None], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Token counts of whole texts, as the library gives them without begin and end tokens."""
    known = counter(path)
    counts: list[int] = [0] * len(texts)
    waiting: list[tuple[int, list[str]]] = []
    held = 0

    def settle() -> None:
        if known.held > MEMO_BYTES:
            known.memo.clear()
            known.held = 0
        known.learn({p for _, parts in waiting for p in parts if p not in known.memo}, batch_bytes)
        for i, parts in waiting:
            counts[i] += sum(map(known.memo.__getitem__, parts))
        waiting.clear()

    for i, text in enumerate(texts):
        for part in slices(text or "", known.spaces, known.marks):
            held += _bytes(part)
            for c in known.spaces[1:]:
                part = part.replace(c, known.spaces[0])
            waiting.append((i, part.split(known.spaces[0]) if known.spaces else [part]))
            if held >= batch_bytes:
                settle()
                held = 0
    settle()
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(batch.column(1).to_pylist(), tokenizer_path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = mapped(slim, encode, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

"""Benchmark decontamination: containment of short test items in whole documents.

An item is the set of its distinct 5-word shingles (fewer words: the whole sequence as one shingle of
its own length).  A document contains it if at least ``THRESHOLD`` of them occur in the document.
The search is MinHash containment over partitions by item size: class ``c`` holds the items of ``2**c`` to
``2**(c+1) - 1`` shingles, and its items keep as many of their smallest hashes as sketch as lets the
largest item of the class miss ``1 - THRESHOLD`` of its shingles and one more.  So a document that contains an
item always shares a sketch value with it, and long items pay for long sketches alone.  Candidates are
verified by the exact number of shared shingles: the wanted shingles of a document's own candidates meet
those of the document, under keys that hold the document's id, so a common shingle multiplies nothing.

Words are runs outside ``[\\x20\\x09-\\x0D]`` of the lower-cased text.  Everything is built-in
functions.  A text is split once, and long ones are cut into overlapping stretches of ``STRETCH`` words
before windows are formed.  Items or documents that are null or have no words match nothing; null ids are
left out; rows with the same document id count as one document, repeated items and texts with the same
item id as one item.  Empty tables, of documents or of items, give an empty result.  Pairs at exactly the
threshold count.  Extra columns, whatever their names, are not read.  Sketch and candidates are broadcast
only below a counted number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, small, stored, stored_and_seen

SHINGLE = 5
THRESHOLD = 0.8
#: Words of a stretch; windows are formed stretch by stretch, which bounds their memory.
STRETCH = 8192
_BLANK = " \t\n\x0b\f\r"
_NO_WORDS = "array<string>"


def word_array(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    trimmed = F.lower(F.btrim(text, F.lit(_BLANK)))
    return F.when(F.length(F.coalesce(trimmed, F.lit(""))) == 0, F.array().cast(_NO_WORDS)).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: str, k: int, count: Column | None = None) -> Column:
    """Hashes of the windows of ``k`` words that begin in the first ``count`` words of an array; none if it is shorter."""
    w = F.col(words)
    last = F.size(w) - F.lit(k)
    at = F.sequence(F.lit(0), last if count is None else F.least(last, count - 1))
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(k)]))
    return F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>"))


def size_class(n: Column) -> Column:
    """The size partition of an item of ``n`` shingles."""
    return F.floor(F.log2(n.cast("double")) + F.lit(1e-9)).cast("int")


def sketch_size(n: Column, threshold: float) -> Column:
    """Hashes that an item of ``n`` shingles keeps: what its class's largest item may miss, and one more."""
    largest = F.pow(F.lit(2.0), size_class(n) + 1) - 1
    return F.least(n, F.floor(largest * F.lit(1 - threshold) + F.lit(1e-9)) + 1).cast("int")


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, k, h, n_item`` of every distinct shingle of every item."""
    w = items.select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    size = F.least(F.size("w"), F.lit(shingle))
    hashes = F.when(size == 1, shingle_hashes("w", 1))
    for k in range(2, shingle + 1):
        hashes = hashes.when(size == k, shingle_hashes("w", k))
    rows = w.select("item_id", size.alias("k"), F.explode(F.array_distinct(hashes)).alias("h")).distinct()
    counts = rows.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return rows.join(counts, "item_id")


def _with_length(k: int) -> Callable[[Column], Column]:
    return lambda h: F.struct(F.lit(k).alias("k"), h.alias("h"))


def document_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``doc_id, k, h`` of every window of the wanted lengths of ``doc_id, w``; one split, one pass."""
    longest = max(lengths)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH))
    cut = F.transform(starts, lambda a: F.slice("w", a + 1, F.lit(STRETCH + longest - 1)))
    stretches = docs.select("doc_id", F.explode(F.when(F.size("w") <= STRETCH, F.array("w")).otherwise(cut)).alias("w"))
    # windows belong to the stretch they begin in
    parts = [F.transform(shingle_hashes("w", k, F.lit(STRETCH)), _with_length(k)) for k in lengths]
    return stretches.select("doc_id", F.explode(F.concat(*parts)).alias("s")).select("doc_id", "s.k", "s.h")


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every contained item."""
    shingles, found = stored_and_seen(item_shingles(items, shingle), F.collect_set("k").alias("lengths"))  # at most ``shingle`` lengths
    lengths = sorted(found["lengths"] or [])
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double")
    ranked = shingles.groupBy("item_id", "k", "n_item").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    sketch = ranked.select("item_id", "k", F.explode(F.slice("hs", F.lit(1), sketch_size(F.col("n_item"), threshold))).alias("h"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_array(F.col("text")).alias("w")).where("doc_id is not null and size(w) > 0")
    met = document_shingles(slim, lengths).join(checked_broadcast(sketch), ["k", "h"])
    pairs, seen = stored_and_seen(met.select("doc_id", "item_id").distinct())
    wanted = small(pairs, seen["rows"]).join(small(shingles, found["rows"]), "item_id")
    ids = checked_broadcast(pairs.select(F.col("doc_id").alias("__doc")).distinct())
    have = document_shingles(slim.join(ids, F.col("doc_id") == F.col("__doc"), "left_semi"), lengths).distinct()
    counted = stored(wanted.join(have, ["doc_id", "k", "h"]).groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared")))
    discard(shingles, pairs)
    need = F.ceil(F.lit(threshold) * F.col("n_item") - F.lit(1e-9))
    share = (F.col("n_shared") / F.col("n_item")).alias("containment")
    return counted.where(F.col("n_shared") >= need).select("doc_id", "item_id", "n_shared", "n_item", share)

"""MinHash near-duplicates by an inverted join on signature coordinates.

Every document has the set of its distinct word shingles and a signature of ``COORDINATES`` minima.
Equal sets collapse into classes first.  A class is posted under each (coordinate, value) pair; pairs
that only one class has are skipped, and of the rest a class posts a prefix, rarest first: two classes
that agree on at least ``t`` of ``K`` coordinates share one of the ``K - t + 1`` rarest of each.  ``t``
lies five standard deviations below the agreement expected at the wanted similarity, so a pair at
exactly that similarity is missed with a chance near 3e-7, and one above it with less.

The classes of a posting meet at its hub, the class whose coordinates are shared most (ties: the smallest
id), and the posting lists of one hub merge into one group.  Nothing is closed transitively: a group is
no larger than the few lists of its hub, and two classes of a posting are always in one group.  A group
skips whatever its hub settles: classes confirmed to be linked with the hub are not compared with each
other again.  The rest count the coordinates on which they collide with every class of the group, pairs
at or above the match threshold are retained and confirmed on the full sets.  Large groups are cut into
blocks and compared by pairs of blocks, the hub being in each; what leaves a task is a forest of links,
never all pairs.  Components of the links are found by alternating stars.

Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A text with fewer words than a
shingle is one shingle; texts that are null or have no words have an empty set and are linked with
nothing.  Rows with a null id are linked with nothing and kept.  Rows that share an id, repeated ones
included, are one document: they have one component, and what links to one of their texts links to it.
Of equals the smallest id is kept.  A very long text is read in segments; its set is one row.  Extra
columns, whatever their names, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checked_broadcast, dealt_anew, discard, mapped, small, stored, stored_and_seen
from .components import components

COORDINATES = 64
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 2_000_000
BATCH_SHINGLES = 500_000
#: Retained pairs of a group up to which sets are met one by one; beyond, as products of incidence columns.
PAIRS_ALONE = 64
_DRAW = np.random.default_rng(20).integers(1, 1 << 63, (3, COORDINATES), dtype=np.uint64)
_FACTOR, _SHIFT, _COORDINATE = _DRAW[0] | np.uint64(1), _DRAW[1], _DRAW[2]


def match_threshold(num: int, den: int) -> int:
    """Agreeing coordinates that a pair at the similarity ``num / den`` misses by five deviations."""
    s = num / den
    return max(1, math.floor(COORDINATES * s - 5 * math.sqrt(COORDINATES * s * (1 - s))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each of ``COORDINATES`` permutations of a non-empty set of hashes, marked by coordinate."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[a : a + 2048, None] ^ _SHIFT) * _FACTOR).min(0))
    return tc.mix(low + _COORDINATE).view(np.int64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = tc.utf8(column)
    for i, j in tc.pieces(offsets):
        part, bounds = tc.text_slice(data, offsets, i, j)
        first, last, doc = tc.words(part, bounds)
        hashes = tc.span_hashes(part, first, last, tc.LOWER)
        edge = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            yield np.unique(tc.grams(hashes[a:b], min(size, b - a))) if b > a else hashes[a:b]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sig``: set size, set digest and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, high, low, signs = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                counts.append(len(s))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                signs.append(signature(s) if len(s) else np.zeros(0, np.int64))
            flat = np.concatenate([*signs, np.zeros(0, np.int64)])
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in signs])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return mapped(slim, run, "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, sig, shingles`` of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, signs, sets, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                shingles = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                edges = pa.array(np.arange(len(at) + 1) * COORDINATES, pa.int32())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(signs))), shingles], ["node", "sig", "shingles"])

            for k, s in enumerate(shingle_sets(batch.column(1), size)):
                if len(s):
                    at.append(k)
                    signs.append(signature(s))
                    sets.append(s)
                    held += len(s)
                if held >= BATCH_SHINGLES:
                    yield made()
                    at, signs, sets, held = [], [], [], 0
            if at:
                yield made()

    return mapped(docs, run, "node long, sig array<long>, shingles array<long>")


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal coordinates of every pair of rows."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every set of ``left`` with every one of ``right``, as products of incidence columns."""
    flat = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    _, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    mine = row < len(left)
    met = np.zeros(int(column.max(initial=-1)) + 1, np.int8)
    met[column[mine]] |= 1
    met[column[~mine]] |= 2
    rank = np.cumsum(met == 3) - 1  # only what both sides have
    keep = met[column] == 3
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, 2048):
        i, j = np.searchsorted(column, [a, a + 2048])
        chunk = np.zeros((len(left) + len(right), min(2048, total - a)), np.float32)
        chunk[row[i:j], column[i:j] - a] = 1
        out += chunk[: len(left)] @ chunk[len(left) :].T
    return out.astype(np.int64)


def group_links(node: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that span what confirmed pairs connect in one pair of blocks of a group.

    ``block`` has -1 for the hub's rows.  Links with the hub come from the pairs of a block with itself;
    in the other pairs only classes of different blocks are compared.
    """
    n, sizes = len(node), np.array([len(s) for s in sets], np.int64)
    hub = int(np.flatnonzero(block == -1)[0])
    row = np.repeat(np.arange(n), sizes)
    met = np.bincount(row[np.isin(np.concatenate(sets), sets[hub])], minlength=n)
    settled = den * met >= num * (sizes + sizes[hub] - met)
    own = len(set(block.tolist()) - {-1}) <= 1
    links = [(int(x), int(node[hub])) for x in node[settled] if x != node[hub]] if own else []
    rest = np.flatnonzero(~settled)
    if not len(rest):
        return links
    wanted = agreements(sig[rest], sig) >= match_threshold(num, den)
    wanted &= den * np.minimum(sizes[rest][:, None], sizes) >= num * np.maximum(sizes[rest][:, None], sizes)
    wanted[:, hub] = False
    turn = np.full(n, n)  # two classes of the rest meet once
    turn[rest] = np.arange(len(rest))
    wanted &= turn > np.arange(len(rest))[:, None]
    if not own:
        wanted &= block[rest][:, None] != block
    root = np.arange(n)
    root[settled] = hub

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    a, b = np.nonzero(wanted)
    if len(a) > PAIRS_ALONE:
        rows = np.unique(a)
        columns = np.unique(b)
        both = shared_counts([sets[k] for k in rest[rows]], [sets[k] for k in columns])[np.searchsorted(rows, a), np.searchsorted(columns, b)]
        fine = den * both >= num * (sizes[rest[a]] + sizes[b] - both)
        a, b = a[fine], b[fine]
        confirmed = True
    else:
        confirmed = False
    for x, y in zip(rest[a].tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p == q:
            continue
        if not confirmed:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if den * both < num * (sizes[x] + sizes[y] - both):
                continue
        root[p] = q
        links.append((int(node[x]), int(node[y])))
    return links


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of every node to the smallest node that the given links connect it with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _linked(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        sets = [np.asarray(x.values.to_numpy()).view(np.uint64) for x in group.column("shingles")]
        sig = np.array([x.values.to_numpy() for x in group.column("sig")])
        found = stars(group_links(group.column("node").to_numpy(), group.column("b").to_numpy(), sig, sets, num, den))
        if len(sets) > 256:
            tc.release()
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return run


def postings(classes: DataFrame, num: int, den: int) -> DataFrame:
    """``node, n, key, weight``: the rarest-first prefix of shared coordinate values of every class that may have a partner.

    ``weight`` says how widely the class's coordinates are shared.
    """
    t = match_threshold(num, den)
    posted = classes.select("node", "n", F.explode("sig").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    met = posted.join(shared.select(dealt_anew("key").alias("k"), "df"), F.col("key") == F.col("k"))
    lists = met.groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("keys"))
    enough = lists.where(F.size("keys") >= t)
    weight = F.round(F.aggregate("keys", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double"))), 6).alias("weight")
    prefix = F.slice("keys", F.lit(1), F.size("keys") - F.lit(t - 1))
    return enough.select("node", "n", weight, F.explode(F.transform(prefix, lambda x: x["key"])).alias("key"))


def groups(entries: DataFrame) -> DataFrame:
    """``hub, blocks, node, b`` of every class in every group; the hub itself has block -1."""
    best = entries.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    met = entries.join(best.select(dealt_anew("key").alias("k"), "hub"), F.col("key") == F.col("k")).where("node <> hub")
    meets = stored(met.select("hub", "node", "n").distinct())
    count = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = stored(meets.groupBy("hub").agg(count.alias("blocks")))
    # groups of one block need no entry here, so it has a row for every thousand meetings at most
    cut = checked_broadcast(sized.where("blocks > 1").withColumnRenamed("hub", "__hub"))
    spread = meets.join(cut, F.col("hub") == F.col("__hub"), "left").select("hub", F.coalesce("blocks", F.lit(1)).alias("blocks"), "node")
    members = spread.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return members.unionByName(sized.select("hub", "blocks", F.col("hub").alias("node"), F.lit(-1).alias("b")))


def links_between(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``u, v``: spanning links of confirmed pairs of classes."""
    entries = stored(postings(classes, num, den))
    places, seen = stored_and_seen(groups(entries))
    nodes = checked_broadcast(places.select("node").distinct())
    slim = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text"))
    # rows repeated under one id would all meet in the groups of that id
    texts = slim.join(nodes, F.col("__doc") == F.col("node")).select("node", "__text").distinct()
    sets = full_sets(texts, size)
    last = F.col("blocks") - 1
    whole = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    crossed = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    held = small(places.withColumnRenamed("node", "__node"), seen["rows"])
    placed = sets.join(held, F.col("node") == F.col("__node")).withColumn("at", F.explode(F.when(F.col("b") < 0, whole).otherwise(crossed)))
    paired = placed.select("hub", "at.i", "at.j", "b", "node", "sig", "shingles")
    links = stored(paired.groupBy("hub", "i", "j").applyInArrow(_linked(num, den), "u long, v long"))
    discard(entries)
    return links


def near_duplicates(docs: DataFrame, size: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked if their shingle sets' intersection is at least ``num / den`` of their union.
    """
    rows = stored(sketches(docs, size))
    real = rows.where("doc_id is not null and n_shingles > 0")
    same = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    # only sets that several rows have need a look-up; under keys that are dealt again, copies of one set can be split
    low = checked_broadcast(same.select(dealt_anew("d1").alias("k1"), dealt_anew("d2").alias("k2"), "low"))
    found = real.join(low, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left").withColumn("node", F.coalesce("low", "doc_id"))
    classes = found.where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "sig")
    # rows of one id with different texts are one document
    ids = found.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("u", "v")
    parts = components(links_between(docs, classes, size, num, den).unionByName(ids)).where("node <> component").toDF("__node", "__component")
    placed = found.select("doc_id", "n_shingles", "node").join(parts, F.col("node") == F.col("__node"), "left")
    linked = placed.select("doc_id", "n_shingles", F.coalesce("__component", "node").alias("component_id"))
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Session helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textcore import release

#: Rows up to which a checked side of a join is broadcast (a few longs a row: a few MB).
BROADCAST_ROWS = 200_000
#: Words are runs of characters outside this class.
WORD = r"[^\x20\x09-\x0D]+"
#: Numbers of rows without an id begin here.
OWN_KEYS = 1 << 62
_PATHS: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a temporary folder is taken.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that outlives executors."""
    return stored_and_seen(df)[0]


def stored_and_seen(df: DataFrame, *seen: Column) -> tuple[DataFrame, Row]:
    """As ``stored``, with aggregates of the rows that are observed while they are written (their number first)."""
    spark, path, watch = df.sparkSession, shared_dir(df.sparkSession), Observation()
    watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *seen)
    watched.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = path
    weakref.finalize(table, _PATHS.pop, id(table), None)
    return table, Row(**watch.get)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing will read them again.

    Spark removes shuffle files and broadcasts only when the driver collects its garbage, which a driver of
    many small jobs seldom does; so it is asked to, and holds little besides.
    """
    for table in tables:
        path = _PATHS.get(id(table))
        if path:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            gc.collect()
            jvm.System.gc()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose worker gives its memory back at the end of a task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def dealt_anew(key: str) -> Column:
    """The same integer as an expression whose partitioning Spark does not know.

    A join on it deals an aggregated side once more, so that both sides are plain exchanges and adaptive
    execution can split the rows of a very common key.
    """
    return F.col(key).bitwiseXOR(F.lit(1)).bitwiseXOR(F.lit(1))


def small(table: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of a known number of rows for broadcast if that is small; leave it as it is beyond."""
    return F.broadcast(table) if rows <= limit else table


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once and counted on the way, marked for broadcast if it proves small."""
    table, seen = stored_and_seen(df)
    return small(table, seen["rows"], limit)


def residue(column: str | Column) -> Column:
    """crc32 of an id as text, modulo 4; a null id has residue 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)), F.lit(0))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key, and the key's column: the id of a row, or for a row without one a number of its own.

    Such numbers are above all ids below ``OWN_KEYS``; only the rows that need them are written.
    """
    name = f"key_{uuid.uuid4().hex}"  # no column of the documents has it
    given = docs.where(F.col("doc_id").isNotNull()).withColumn(name, F.col("doc_id").cast("long"))
    nameless = docs.where(F.col("doc_id").isNull())
    if not nameless.limit(1).count():
        return given, name
    return given.unionByName(stored(nameless.withColumn(name, F.lit(OWN_KEYS) + F.monotonically_increasing_id()))), name


def without_ids(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``gone`` (one column); all columns and null ids stay."""
    name = f"gone_{uuid.uuid4().hex}"  # no column of the documents has it
    ids = gone.toDF(name).distinct()
    return docs.join(checked_broadcast(ids), docs[key] == F.col(name), "left_anti")


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rank, fold, y, text`` and ``extra`` columns of at most ``bound`` labelled texts outside the held-out fold.

    The sample is that of the smallest hashes of the id, one row for each id: of rows that share an id the
    one whose text (then ``extra``) is least, whatever the layout.  An id is positive if any label of it is.
    The ids are few enough to be broadcast, and rows number ``bound`` at most.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (residue("doc_id") != 2))
        .groupBy(F.col("doc_id").cast("long").alias("__label_id"))
        .agg(F.max(F.col(label).cast("int")).alias("__y"))
        .orderBy(F.xxhash64("__label_id"), "__label_id")
        .limit(bound)
    )
    slim = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text", *extra)
    row = F.struct("text", *extra)
    one = slim.join(F.broadcast(ids), F.col("__doc") == F.col("__label_id")).groupBy("__doc", "__y").agg(F.min(row).alias("__row"))
    fold = F.pmod(F.xxhash64("__doc", F.lit(7)), F.lit(2)).cast("int").alias("fold")
    y = (F.col("__y") > 0).cast("int").alias("y")
    return one.select(fold, y, F.col("__row.text").alias("text"), F.xxhash64("__doc").alias("rank"), *[F.col(f"__row.{c}").alias(c) for c in extra])


def filtered(docs: DataFrame, text: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose text the judge keeps; whole rows pass, whatever their columns.

    ``judge`` maps a column of texts to a boolean array.  Nothing is shuffled or joined, so repeated
    and null ids need no care.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at)), pa.bool_()))

    return mapped(docs, run, docs.schema)

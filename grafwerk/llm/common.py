"""Shared helpers: loading tables, cutting lineage, fixed-size broadcasts, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts in one Arrow batch; very long texts must not pile up in a Python worker.
TEXT_BATCH_ROWS = 1000

#: White space that separates words, and the same as a regular expression.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t\n\x0B\f\r]"
WORD_PATTERN = r"[^ \t\n\x0B\f\r]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a single machine (as in tests) gets a folder of this user's; a cluster gets
    an error, since what an executor writes to its own disk is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "grafwerk-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage and
    keeps the result when executors are lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of stored tables that is deleted at the end of the ``with`` block."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.made = spark, f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def store(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


#: Keys that are joined apart from the rest: the most frequent ones with this many rows or more.
HOT_KEYS, HOT_ROWS = 2000, 10_000


def spread_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``unique`` (at most one row a key), whatever share of the rows one key holds.

    A small ``unique`` is broadcast, after a check of its size.  Otherwise the HOT_KEYS most frequent keys
    are, and each other key holds less than one row in HOT_KEYS or few.  ``rows`` should be a stored table, since it
    is read twice; ``counts`` (key, held) may hold the counts of its frequent keys.
    """
    spark = rows.sparkSession
    size = int(str(unique._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()):
        return rows.join(F.broadcast(unique), key, how)
    counts = rows.groupBy(key).agg(F.count("*").alias("held")) if counts is None else counts
    hot = [r[0] for r in counts.where((F.col("held") > HOT_ROWS) & F.col(key).isNotNull()).orderBy(F.desc("held")).limit(HOT_KEYS).select(key).collect()]
    if not hot:
        return rows.join(unique, key, how)
    some = F.col(key).isin(hot)
    return rows.where(~some | F.col(key).isNull()).join(unique, key, how).unionByName(rows.where(some).join(F.broadcast(unique.where(some)), key, how))


def fresh(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that ``columns`` doesn't have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def fold(column: Column | str) -> Column:
    """crc32 of an id's text, modulo 4; fold 2 is held out everywhere."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit(""))) % 4


def held_out(column: Column | str) -> Column:
    return fold(column) == 2


def texts_as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_as_str(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """Partitions that keep each at about ``per_partition`` rows, however many rows there are."""
    return max(least, -(-rows // per_partition))

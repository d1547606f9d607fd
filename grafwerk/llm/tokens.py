"""Token ids: the encoder, flat token files, and counting tokens by a separator scan.

A token file is a flat run of little-endian ids; every document ends with one separator id, and
there is no index.  :func:`count_tokens` cuts files into blocks of a fixed number of bytes; a
task looks for separators in a block with one vectorised comparison.  Since a block's place in
its file is known, only two prefix scans over one small row for each block are left to stitch
documents that cross blocks: the last separator before a block (running maximum) and the number
of documents before it (running sum).

Defined cases: null or empty text is a document of 0 tokens; a separator's string inside a text is
ordinary text; ids after a file's last separator are one unfinished document; an empty file
holds none; a file whose size is no multiple of an id's is an error; rows with one id are documents of their own;
an empty table writes no ids; further columns are ignored, whatever their names; a tokenizer with ids beyond 16 bits is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafwerk.llm.common import partitions_for, small_batches, store, texts_as_str

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into words before merging.
WORD_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
ID_TYPE = np.dtype("<u2")
#: Bytes of a block, a multiple of an id's size, and blocks of a task.
BLOCK_BYTES, TASK_BLOCKS = 4 << 20, 16

_encoders: dict[str, object] = {}


class Encoder:
    """Byte-level BPE from a file of ranks; the separator is the first free id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.separator = max(ranks.values()) + 1
        if self.separator > np.iinfo(ID_TYPE).max:
            raise ValueError(f"{path}: ids up to {self.separator} don't fit {ID_TYPE}")
        self._encoding = tiktoken.Encoding("ranks", pat_str=WORD_CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self._encoding.decode(ids)


def encoder(path: str = TOKENIZER) -> Encoder:
    """One for each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def publish(uri: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write a file whole: under a name of this attempt first, then moved."""
    files, folder = pyarrow.fs.FileSystem.from_uri(uri)
    task = TaskContext.get()
    own = f"{folder}/_{name}.{task.taskAttemptId() if task else 0}"
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(own, f"{folder}/{name}")


def write_token_files(docs: DataFrame, uri: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write a token file for each partition below ``uri``.  Returns (doc_id, file, ordinal): where
    each document went, for readers that want ids; the files don't need it."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("ordinal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        ids: list[list[int | None]] = []

        def chunks() -> Iterator[bytes]:
            for batch in batches:
                ids.append(batch.column(0).to_pylist())
                for text in texts_as_str(batch.column(1)):
                    yield np.array([*encode.encode(text), encode.separator], ID_TYPE).tobytes()

        publish(uri, name, chunks())
        done = 0
        for part in ids:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([name] * len(part)), pa.array(range(done, done + len(part)), pa.int64())], schema=schema)
            done += len(part)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, file string, ordinal long")


def _blocks(spark: SparkSession, uri: str, block_bytes: int) -> DataFrame:
    """(file, block, size): all blocks of all files."""
    files, folder = pyarrow.fs.FileSystem.from_uri(uri)
    found = [(f.base_name, f.size) for f in files.get_file_info(pyarrow.fs.FileSelector(folder)) if f.is_file and f.base_name.endswith(".bin") and not f.base_name.startswith("_")]
    for name, size in found:
        if size % ID_TYPE.itemsize:
            raise ValueError(f"{name}: {size} bytes are no whole number of ids")
    listed = spark.createDataFrame([(n, s) for n, s in sorted(found) if s], "file string, size long")
    blocks = sum(-(-s // block_bytes) for _, s in found)
    rows = listed.select("file", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_bytes))).alias("block"))
    return rows.repartition(partitions_for(blocks, TASK_BLOCKS, least=min(blocks, 8))) if blocks else rows


def count_tokens(spark: SparkSession, uri: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, finished) of every document in the token files below ``uri``."""
    each = block_bytes // ID_TYPE.itemsize
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("docs", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, _, block in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_file(f"{folder}/{name}") as data:
                    data.seek(block * each * ID_TYPE.itemsize)
                    ids = np.frombuffer(data.read(each * ID_TYPE.itemsize), ID_TYPE)
                ends = np.flatnonzero(ids == separator) + block * each
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    blocks = _blocks(spark, uri, block_bytes)
    found = store(blocks.mapInArrow(run, "file string, block long, docs long, last long, ends array<long>"), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("file", "block", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    ended = found.where("docs > 0").join(stitched, ["file", "block"])
    lengths = F.transform("ends", lambda end, i: end - F.when(i == 0, F.col("previous")).otherwise(F.get("ends", i - 1)) - 1)
    finished = ended.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("finished"))
    sizes = blocks.groupBy("file").agg(F.first("size").alias("size"))
    tail = found.groupBy("file").agg(F.sum("docs").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last")).join(sizes, "file")
    tail = tail.select("file", "ordinal", (F.floor(F.col("size") / ID_TYPE.itemsize) - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("finished")).where("n_tokens > 0")
    return finished.unionByName(tail)

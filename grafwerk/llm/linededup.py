"""Line deduplication with two Bloom filters and an exact confirmation.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.
A key of at least ``min_chars`` code points that is found in at least ``min_docs`` documents
loses all its lines, except in the document with the largest id that holds it.

1. The filters grow with the data: shards of ``SHARD_BITS`` bits, dealt by the key's hash, as many as
   ``BITS_PER_DOC`` bits a document need.  Every task sets the bits of its keys (each key once a document) in
   the shards' two bit sets: *once* for all, *twice* for those of two or more documents.  Bit sets merge in a tree,
   shard by shard: ``once = a.once | b.once``, ``twice = a.twice | b.twice | (a.once & b.once)``.
   A key of two documents is in *twice* for certain; other keys get there by chance only.
2. Only keys in *twice* are shuffled, as 128-bit digests with the document's id.  Counting
   first by (key, document) and then by key with partial sums leaves no hot task.  This
   confirms repeats exactly and picks the document that keeps its lines.
3. The keys to drop go back to the documents: as a broadcast where their count is small, by a
   join on the document's id otherwise.

A scan of the documents looks keys up in at most ``SCAN_SHARDS`` shards, a broadcast of a fixed size; more
shards take more scans.  Where that would be more than ``MOST_SCANS`` (from about 33 million documents on), scans
cost more than the filters save: all keys are shuffled then, as digests.  The result is the same.

Defined cases: null or empty text is one empty line; rows with a null id keep all their lines
and don't count as documents; rows that share an id count as one document; further columns
pass through :func:`dedup_lines` unchanged, but for n_lines and n_dropped, which are replaced; very long texts are
read whole, one at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafwerk.llm.common import SPACE_BYTES, Scratch, fresh, small_batches, spread_join, store, texts_as_bytes

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of filter for each document, bits of a shard, and the least number of bits of the only shard.
BITS_PER_DOC, SHARD_BITS, MIN_BITS = 128, 1 << 24, 1 << 16
#: Shards that one scan looks keys up in (128 MB), and scans.
SCAN_SHARDS, MOST_SCANS = 64, 4
#: Filters of a shard that one merging step reads, and keys that a task holds before it writes their filters.
MERGE_FAN, HELD_KEYS = 16, 1_000_000
#: Keys to drop that are broadcast; more are joined.
BROADCAST_KEYS = 100_000


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z only


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    """Long enough keys of a text, each once."""
    found = {line_key(line) for line in text.split(b"\n") if len(line) >= min_chars}
    return {k for k in found if _long_enough(k, min_chars)}


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _digests(keys: Iterable[bytes]) -> np.ndarray:
    """Rows of two 64-bit words."""
    return np.frombuffer(b"".join(map(_digest, keys)), np.uint64).reshape(-1, 2)


def _shards(digests: np.ndarray, shards: int) -> np.ndarray:
    return ((digests[:, 0] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _bit_positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two positions in the shard for each digest."""
    return (digests % np.uint64(bits)).astype(np.int64)


def _packed(positions: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[positions.ravel()] = True
    return zlib.compress(np.packbits(out).tobytes(), 1)


def _holds(packed: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set."""
    return ((packed[positions >> 3] >> (7 - (positions & 7)).astype(np.uint8)) & 1).all(axis=1)


FILTER_SCHEMA = T.StructType([T.StructField("shard", T.LongType()), T.StructField("part", T.LongType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_FILTER_ARROW = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _filter_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FILTER_ARROW)], schema=_FILTER_ARROW)


def _local_filters(bits: int, shards: int, min_chars: int):
    def filters(held: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        shard = _shards(every, shards)
        for number in np.unique(shard).tolist():
            found, counts = np.unique(every[shard == number], axis=0, return_counts=True)
            yield _filter_batch([(number, part, _packed(_bit_positions(found, bits), bits), _packed(_bit_positions(found[counts > 1], bits), bits))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 20
        held, size = [], 0
        for batch in batches:
            for text in texts_as_bytes(batch.column(0)):
                if keys := _keys(text, min_chars):
                    held.append(_digests(keys))
                    size += len(keys)
                    if size >= HELD_KEYS:
                        yield from filters(held, part)
                        held, size, part = [], 0, part + 1
        if held:
            yield from filters(held, part)

    return run


def _merge_filters(slots: int):
    """Merges packed bits by (shard, slot); a byte at a time, the formulas are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, part, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                key = (shard, part % slots)
                if key not in merged:
                    merged[key] = a.copy(), b.copy()
                    continue
                once, twice = merged[key]
                twice |= b
                twice |= once & a
                once |= a
        for (shard, slot), (once, twice) in merged.items():
            yield _filter_batch([(shard, slot, *(zlib.compress(x.tobytes(), 1) for x in (once, twice)))])

    return run


def filter_size(documents: int) -> tuple[int, int]:
    """(bits of a shard, shards)."""
    wanted = max(MIN_BITS, 1 << (documents * BITS_PER_DOC).bit_length())
    return (wanted, 1) if wanted <= SHARD_BITS else (SHARD_BITS, wanted // SHARD_BITS)


def twice_filters(scratch: Scratch, docs: DataFrame, bits: int, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(shard, part, once, twice): the filters of all documents, a row for each shard with keys."""
    filters = scratch.store(docs.select("text").mapInArrow(_local_filters(bits, shards, min_chars), FILTER_SCHEMA))
    while (most := filters.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) > 1:
        slots = -(-most // MERGE_FAN)
        dealt = filters.repartition(min(shards * slots, 10_000), "shard", F.col("part") % slots)
        filters = scratch.store(dealt.mapInArrow(_merge_filters(slots), FILTER_SCHEMA))
    return filters


SUSPECT_SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", T.LongType())])
_SUSPECT_ARROW = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])


def _suspects(twice, bits: int, shards: int, min_chars: int):
    """Keys that may repeat, with their document's id; ``twice``: the filters of some shards, or None for all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {n: np.frombuffer(zlib.decompress(x), np.uint8) for n, x in twice.value.items()} if twice else {}
        for batch in batches:
            rows: list[tuple[bytes, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                if not (keys := _keys(text, min_chars)):
                    continue
                digests = _digests(keys)
                if twice is None:
                    rows += [(d.tobytes(), doc) for d in digests]
                    continue
                shard, positions = _shards(digests, shards), _bit_positions(digests, bits)
                for number in np.unique(shard).tolist() if shards > 1 else [0]:
                    if number in seen:
                        own = np.flatnonzero(shard == number)
                        rows += [(digests[i].tobytes(), doc) for i in own[_holds(seen[number], positions[own])]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.int64())], schema=_SUSPECT_ARROW)

    return run


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(suspects(key, doc_id), repeats(key, keeper)): what is shuffled, and the confirmed keys."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits, shards = filter_size(ids.count())
    scans = -(-shards // SCAN_SHARDS)
    with Scratch(spark, "line-filters") as scratch:
        parts = []
        if scans > MOST_SCANS:
            parts.append(ids.mapInArrow(_suspects(None, bits, shards, min_chars), SUSPECT_SCHEMA))
        else:
            filters = twice_filters(scratch, ids, bits, shards, min_chars)
            for scan in range(scans):
                rows = filters.where((F.col("shard") >= scan * SCAN_SHARDS) & (F.col("shard") < (scan + 1) * SCAN_SHARDS)).select("shard", "twice").collect()
                some = spark.sparkContext.broadcast({r["shard"]: bytes(r["twice"]) for r in rows})  # SCAN_SHARDS filters of SHARD_BITS
                parts.append(ids.mapInArrow(_suspects(some, bits, shards, min_chars), SUSPECT_SCHEMA))
        suspects = store(reduce(DataFrame.unionByName, parts).distinct(), "line-suspects")
    repeats = suspects.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    return suspects, store(repeats.select("key", "keeper"), "line-repeats")


def _kept(text: bytes, dropped: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    """(kept text, lines, dropped lines)."""
    lines = text.split(b"\n")
    if not dropped:
        return text, len(lines), 0
    kept = [x for x in lines if len(x) < min_chars or not _long_enough(k := line_key(x), min_chars) or _digest(k) not in dropped]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _applied(schema: pa.Schema, min_chars: int, drops, table):
    """Rewrites the text column.  drops: index of a column of digests, or None to look keys
    up in the broadcast ``table`` (digest -> keeper)."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value if table is not None else None
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = texts_as_bytes(batch.column(at["text"]))
            out, lines, dropped = [], [], []
            extra = batch.column(at[drops]).to_pylist() if drops else batch.column(at["doc_id"]).to_pylist()
            for text, x in zip(texts, extra):
                if drops:
                    keys = set(x or ())
                elif known and x is not None:
                    keys = {d for k in _keys(text, min_chars) if (keeper := known.get(d := _digest(k))) is not None and keeper != x}
                else:
                    keys = set()
                a, b, c = _kept(text, keys, min_chars)
                out.append(a)
                lines.append(b)
                dropped.append(c)
            made = {"text": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(at[n]).cast(schema.field(n).type) for n in names], schema=schema)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_lines, n_dropped (long)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    clash = [c for c in docs.columns if c in ("n_lines", "n_dropped")]
    docs = docs.drop(*clash)
    suspects, repeats = repeated_keys(docs, min_chars, min_docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    arrow = to_arrow_schema(schema)
    if repeats.count() <= broadcast_keys:
        table = spark.sparkContext.broadcast({bytes(k): keeper for k, keeper in repeats.collect()})
        return docs.mapInArrow(_applied(arrow, min_chars, None, table), schema)
    drop, own = fresh("drop", docs.columns), fresh("own", docs.columns)
    lost = spread_join(suspects, repeats, "key").where(F.col("doc_id") != F.col("keeper")).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("key").alias(drop))  # as many as the document has lines
    joined = docs.join(lost, F.col("doc_id") == F.col(own), "left").drop(own)
    return joined.mapInArrow(_applied(arrow, min_chars, drop, None), schema)


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> dict[int, tuple[int, int, str]]:
    """Plain Python for tests: id -> (n_lines, n_dropped, sha256 of the kept text)."""
    space = SPACE_BYTES.decode()
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(space).translate(lower)
    holders: dict[str, set[int]] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := key(x)) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out

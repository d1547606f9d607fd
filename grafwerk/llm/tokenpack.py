"""Packed token matrices by best-fit-decreasing, written as flat binary files.

Every document's ids, closed by a separator, are cut losslessly into pieces of at most ``ROW``
ids.  A task packs the pieces of a bounded buffer of documents: by falling length, each into the
row with the least room that is enough.  A segment tree over the amounts of room finds that row in
O(log ROW).  No ids are shuffled; a source or a group of copies of any size is packed where it is read.

Each partition writes four files to the shared folder: ``*.ids`` (rows of ROW ids, filled up with
the separator), ``*.cu`` (for each row the number of its segments and their cumulative lengths),
``*.pos`` (for each row the number of segments and the places where positions restart at 0) and
``*.doc`` (document id, ``NULL_ID`` if null, and piece of each segment).  All but the ids are 64-bit.

Defined cases: null or empty text is one separator; rows that share an id are packed one by one;
an empty table writes no rows; very long texts are cut into rows like others; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import small_batches, texts_as_str
from grafwerk.llm.tokens import ID_TYPE, TOKENIZER, encoder, publish

#: Stands for a null id in the files.
NULL_ID = -(2**63)

#: Ids of a row, and of a buffer that is packed at once.
ROW, BUFFER_IDS = 2048, 4 << 20


class Rooms:
    """A segment tree over the amounts of room 0..size: which have an open row."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with at least so much room."""
        at = self.leaves + least
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):  # up, until the right sibling has one
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows as lists of indices into ``lengths``, each at most ``row``."""
    rooms, rows = Rooms(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        room, at = found or (row, len(rows))
        if not found:
            rows.append([])
        rows[at].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], at)
    return rows


def _buffers(batches: Iterator[pa.RecordBatch], tokenizer: str, row: int, buffer_ids: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (doc_id, piece, ids)."""
    encode = encoder(tokenizer)
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts_as_str(batch.column(1))):
            ids = np.array([*encode.encode(text), encode.separator], ID_TYPE)
            held += [(doc, p, ids[a : a + row]) for p, a in enumerate(range(0, len(ids), row))]
            size += len(ids)
            if size >= buffer_ids:
                yield held
                held, size = [], 0
    if held:
        yield held


def write_packed(docs: DataFrame, uri: str, row: int = ROW, tokenizer: str = TOKENIZER, buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """Write matrices below ``uri``.  Returns a row for each segment: (doc_id, piece, file, row,
    start, length)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("file", pa.string()), ("row", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        fill = encoder(tokenizer).separator
        side: dict[str, list[bytes]] = {"cu": [], "pos": [], "doc": []}
        out: list[pa.RecordBatch] = []

        def chunks() -> Iterator[bytes]:
            number = 0
            for held in _buffers(batches, tokenizer, row, buffer_ids):
                rows = best_fit_decreasing([len(ids) for _, _, ids in held], row)
                matrix = np.full((len(rows), row), fill, ID_TYPE)
                columns: tuple[list, ...] = ([], [], [], [], [])
                for r, members in enumerate(rows):
                    ends = np.cumsum([0, *(len(held[i][2]) for i in members)])
                    matrix[r, : ends[-1]] = np.concatenate([held[i][2] for i in members])
                    side["cu"].append(np.array([len(members), *ends], "<i8").tobytes())
                    side["pos"].append(np.array([len(members), *ends[:-1]], "<i8").tobytes())
                    side["doc"].append(np.array([NULL_ID if x is None else x for i in members for x in held[i][:2]], "<i8").tobytes())
                    for i, start in zip(members, ends):
                        for column, value in zip(columns, (held[i][0], held[i][1], number + r, int(start), len(held[i][2]))):
                            column.append(value)
                number += len(rows)
                docs_, pieces, at, starts, lengths = columns
                ids = pa.array(docs_, pa.int64())
                out.append(pa.RecordBatch.from_arrays([ids, pa.array(pieces, pa.int32()), pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], schema=schema))
                yield matrix.tobytes()

        publish(uri, f"{name}.ids", chunks())
        for kind, parts in side.items():
            publish(uri, f"{name}.{kind}", iter(parts))
        yield from out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, file string, row long, start int, length int")


def read_packed(uri: str, name: str, row: int = ROW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, cumulative lengths, restarts, (doc, piece) pairs) of each row of a partition's files."""
    files, folder = pyarrow.fs.FileSystem.from_uri(uri)

    def load(kind: str, dtype: str | np.dtype) -> np.ndarray:
        with files.open_input_file(f"{folder}/{name}.{kind}") as data:
            return np.frombuffer(data.read(), dtype)

    ids, cu, pos, doc = load("ids", ID_TYPE).reshape(-1, row), load("cu", "<i8"), load("pos", "<i8"), load("doc", "<i8").reshape(-1, 2)
    a = b = c = 0
    for line in ids:
        n = int(cu[a])
        yield line, cu[a + 1 : a + 2 + n], pos[b + 1 : b + 1 + n], doc[c : c + n]
        a, b, c = a + 2 + n, b + 1 + n, c + n

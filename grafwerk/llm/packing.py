"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt by the hash of their id (without one, of their text) into shards of about ``SHARD_DOCS`` rows, so one
source or one group of copies is spread over all shards and no task grows with the data.  In a
shard, pieces are taken by falling length.  Open bins are ordered by what is left in them and
carry two bitmaps: the sources and the duplicate clusters that they hold.  The search starts at
the tightest bin that has room (the successor of the piece's length) and goes on to the next
larger ones until a bin holds neither the piece's source nor its cluster; a new bin is opened
if there is none.

A document longer than a bin gives full pieces, each alone in a bin, and a rest that is packed.

Defined cases: a document without tokens has one row with bin null; a null source or an empty
text conflicts with nothing; ties go to the smaller id and the older bin; rows with one id are
packed each for itself; very long texts fill bins of their own; an empty table has no bins; only the columns named
are read, whatever else there is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import WORD_PATTERN, partitions_for

#: Tokens of a bin, and rows of a shard.
CAPACITY, SHARD_DOCS = 2048, 4096

PACKED = "doc_id long, piece int, n_tokens long, bin long, offset long, source string, cluster long"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def copy_cluster(text: Column) -> Column:
    """The same number for texts that are equal but for case and white space; null if empty."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.trim(plain) == "", None).otherwise(F.xxhash64(F.trim(plain)))


def best_fit(items: Iterable[tuple[int, int | None, int | None]], capacity: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each (tokens, source bit, cluster bit), in order; tokens <= capacity."""
    left: list[tuple[int, int]] = []  # (what is left, bin), ordered
    sources: list[int] = []
    clusters: list[int] = []
    for tokens, source, cluster in items:
        s, c = (0 if source is None else 1 << source), (0 if cluster is None else 1 << cluster)
        at = bisect_left(left, (tokens, -1))
        while at < len(left) and (sources[left[at][1]] & s or clusters[left[at][1]] & c):
            at += 1
        if at < len(left):
            room, number = left.pop(at)
        else:
            room, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= s
        clusters[number] |= c
        if room > tokens:
            insort(left, (room - tokens, number))
        yield number, capacity - room


def pack_shard(shard: int, rows: list[tuple], capacity: int) -> list[tuple]:
    """rows: (doc_id, tokens, source, cluster).  Bins are numbered within the shard."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or 0))
    source_bit = {s: i for i, s in enumerate(sorted({r[2] for r in rows if r[2] is not None}))}
    seen: dict[int, int] = {}
    for r in rows:
        if r[3] is not None:
            seen[r[3]] = seen.get(r[3], 0) + 1
    cluster_bit = {c: i for i, c in enumerate(sorted(c for c, n in seen.items() if n > 1))}  # alone, it conflicts with nothing
    out, rest, full = [], [], 0
    base = shard << 32
    for doc, tokens, source, cluster in rows:
        if not tokens:
            out.append((doc, 0, 0, None, 0, source, cluster))
        whole, more = divmod(tokens, capacity)
        for piece in range(whole):
            out.append((doc, piece, capacity, base + full, 0, source, cluster))
            full += 1
        if more:
            rest.append((more, doc, whole, source, cluster))
    rest.sort(key=lambda r: -r[0])
    places = best_fit(((r[0], source_bit.get(r[3]), cluster_bit.get(r[4])) for r in rest), capacity)
    out += [(doc, piece, more, base + full + number, offset, source, cluster) for (more, doc, piece, source, cluster), (number, offset) in zip(rest, places)]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """A row for each piece of a document: its bin, and its first token's place in the bin."""
    text = F.col("text").cast("string")
    shards = partitions_for(docs.count(), shard_docs)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(word_count(text) if tokens is None else tokens.cast("long"), F.lit(0)).alias("tokens"),
        F.col("source").cast("string").alias("source"),
        (copy_cluster(text) if cluster is None else cluster.cast("long")).alias("cluster"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text)), F.lit(shards)).cast("long").alias("shard"),
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(None if pd.isna(x) else x for x in r) for r in group[["doc_id", "tokens", "source", "cluster"]].astype(object).itertuples(index=False, name=None)]
        rows = [(None if d is None else int(d), int(t), s, None if c is None else int(c)) for d, t, s, c in rows]
        found = pd.DataFrame(pack_shard(int(key[0]), rows, capacity), columns=[c.split()[0] for c in PACKED.split(", ")], dtype=object)
        return found.astype({"doc_id": "Int64", "piece": "int32", "n_tokens": "int64", "bin": "Int64", "offset": "int64", "cluster": "Int64"})

    return sized.groupBy("shard").applyInPandas(run, PACKED)

"""Exact n-gram Jaccard join as a metric-space join, and its connected components.

A document's set holds the distinct ``width``-word shingles of its lower-cased (A-Z) words; with
fewer words, the whole sequence as one; without words it is empty and linked with nothing.  Two
documents link when ``den * |intersection| >= num * |union|``, a Jaccard distance of at most r.

Equal sets are collapsed first, by 128-bit digests: everything below is about different sets.

*Pivots.*  Almost all documents are at distance 1 from each other, where no pivot tells them apart, so
pivots are elected where documents meet: in the shingles of their prefixes.  All shingles have one total
order, rarest first by a sketch of counts over all texts (any order is exact, this one is fast); the prefix
of a set of n holds its first ``n - ceil(n * num / den) + 1``, and linked sets share a shingle of both
prefixes.  With k - 1 more shingles in the smaller prefix, and as many or more in the larger, they share k.  So prefixes
are made longer by n / ``MORE``, and sets that share too few shingles of theirs with others can have no link: they
leave, which may leave others with too few, in rounds until hardly any go.  Whether a shingle is shared is counted
among the sets that meet in it, of which there are few (``HOT``, ``HOT_MEANS``); one that the sketch counts more often is taken
as shared, so no hot shingle is gathered anywhere.  The sets that meet in a
shingle elect the one that meets most others.  Where more than ``CROWD`` sets meet in a shingle, shingles are
counted exactly among these sets, and the common ones go to the end of the order, once.

*Regions.*  The region of a pivot holds all sets that meet it, so every link lies in a region.  Distances
to the pivot come first: those within r are links, and what is in one component by now needn't be compared.
Two members at distances a and b of a pivot can link only if |a - b| <= r: this window is applied before
sets are compared, and members that have no partner left leave the region.

*Recursion.*  A region of bounded size is joined in one task: new pivots are elected in the groups that the
windows leave until a group is small or no longer shrinks, and the pairs left are counted.  A larger region is
cut on the cluster: it elects ``PIVOTS`` pivots, all members get their distances to all of them, each goes to
the Voronoi cell of its nearest, and into every other cell whose pivot is at most 2r farther (if x and y link,
the one's distance to the other's pivot exceeds that to its own by 2r at most, so the cell of x holds y).  Cells
are regions of the next round.  A region whose cells don't shrink is cut into rings of width r about a pivot,
and rings into tiles; only tiles of the same or the next ring are joined.

All loops keep their state in tables of the shared folder, deleted at the end; no group is collected into a
task or the driver.

Defined cases: null text has an empty set; rows with one id are separate members with that id; a
component's id is its smallest document id (null ids don't count; a group without ids has none); very long texts are read
in blocks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.llm.common import Scratch, small_batches, spread_join, store, texts_as_bytes
from grafwerk.llm.shingles import shingle_lists, shingle_sets

WIDTH, SIMILARITY = 4, (85, 100)
#: Counters of the sketch that orders shingles (a broadcast of one byte each), and their blocks.
COUNTERS, BLOCKS = 1 << 22, 256
#: A prefix is longer by its set's size over this; rounds in which sets leave end when no more than this share goes.
MORE, ENDS = 32, 0.05
#: Occurrences, by the sketch, from which on a shingle counts as shared; and at least this many times a counter's mean.
HOT, HOT_MEANS = 20_000, 16
#: Sets that meet in a shingle before its sets' shingles are counted exactly.
CROWD = 1000
#: Members and elements of a region, or tile, that one task joins; elements of the regions in a task.
TILE_MEMBERS, TILE_ELEMENTS, GROUP_ELEMENTS = 1024, 1_000_000, 1_000_000
#: Pivots that a large region elects, and the share of its members that a cell may hold to count as smaller.
PIVOTS, SHRINKS = 4, 0.8
#: Members of a group that are compared without a further pivot; holders from which on a shingle is common.
LEAF, COMMON = 24, 8
#: Ids that are broadcast to pick out the documents of sets; more are joined.
BROADCAST_IDS = 500_000

_SHIFT = np.uint64(64 - (COUNTERS.bit_length() - 1))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


# -- the order of shingles


_BLOCK_ARROW = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for found in shingle_lists(texts_as_bytes(batch.column(0)), width):
                np.add.at(counts, (found >> _SHIFT).view(np.int64), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1)
        parts = np.minimum(counts, 65535).astype(np.uint16).reshape(BLOCKS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pack.compress(parts[i].tobytes()) for i in used], pa.binary())], schema=_BLOCK_ARROW)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(unpack.decompress(counts), np.uint16).astype(np.int64)
    levels = {b: np.minimum(255, np.round(8 * np.log2(1 + s))).astype(np.uint8) for b, s in sums.items()}
    yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array([x.tobytes() for x in levels.values()], pa.binary())], schema=_BLOCK_ARROW)


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """A level for each counter: the higher, the more often its shingles occur in all texts."""
    counted = docs.select("text").mapInArrow(_counted(width), "block int, counts binary")
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint8)
    for row in counted.repartition(16, "block").mapInArrow(_summed, "block int, counts binary").collect():
        out[row.block] = np.frombuffer(row.counts, np.uint8)
    return out.ravel()


def hot_level(levels: np.ndarray) -> int:
    mean = float((2.0 ** (np.arange(256) / 8) - 1) @ np.bincount(levels, minlength=256)) / len(levels)
    return min(255, round(8 * math.log2(1 + max(HOT, HOT_MEANS * mean))))


def prefix(items: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set (sorted, distinct), rarest first; ties by value."""
    length = prefix_length(len(items), num, den) + len(items) // MORE
    order = np.argsort(levels[(items >> _SHIFT).view(np.int64)], kind="stable")
    return items[order[:length]]


# -- sets and where they meet


_NAMED_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("d", pa.binary()), ("rare", pa.int32()), ("prefix", pa.list_(pa.int64()))])


def _named(width: int, num: int, den: int, levels, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(texts_as_bytes(batch.column(2)), width))
            prefixes = [prefix(s, levels.value, num, den) for s in sets]
            rare = [int((levels.value[(p >> _SHIFT).view(np.int64)] < hot).sum()) for p in prefixes]
            prefixes = [p.view(np.int64) for p in prefixes]
            ends = np.cumsum([0] + [len(p) for p in prefixes])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)) if prefixes else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(map(digest, sets), pa.binary()), pa.array(rare, pa.int32()), lists], schema=_NAMED_ARROW)

    return run


_SET_ARROW = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("items", pa.binary())])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(texts_as_bytes(batch.column(2)), width))
            kept = [i for i, (d, s) in enumerate(zip(batch.column(1).to_pylist(), sets)) if digest(s) == d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array([sets[i].tobytes() for i in kept], pa.binary())], schema=_SET_ARROW)

    return run


def _items(scratch: Scratch, docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, n, items) of the wanted sets, from the text of one document of each."""
    wanted = scratch.store(wanted.join(sets.select("sid", "d", F.col("first.doc_id").alias("__id"), F.col("first.mark").alias("__mark")), "sid"))
    rows = wanted.count()
    if rows <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, (F.col("mark") == F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("sid", "d", "text")
    items = scratch.store(texts.mapInArrow(_sets(width), "sid long, n long, items binary"))
    return items if items.count() == rows else scratch.store(items.dropDuplicates(["sid"]))  # repeated rows


_ELEMENT_ARROW = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("cell", pa.int64()), ("level", pa.int16())])


def _elements(levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, items in zip(*(c.to_pylist() for c in batch.columns)):
                items = np.frombuffer(items, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, sid)), pa.array(np.full(n, n)), pa.array(items.view(np.int64)), pa.array(levels.value[(items >> _SHIFT).view(np.int64)].astype(np.int16))], schema=_ELEMENT_ARROW)

    return run


def _survivors(scratch: Scratch, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, cell) of longer prefixes: the sets that share enough of it with others, and what they share."""
    overlap = f"((n * {num} + {den - 1}) div {den})"
    sizes = sets.select("sid", F.expr(f"1 + {overlap} div {MORE}").alias("need"))
    cells = sets.select("sid", F.posexplode("prefix").alias("place", "cell"), "rare").select("sid", "cell", (F.col("place") >= F.col("rare")).alias("hot"))
    while True:
        held = F.count("*").over(Window.partitionBy("cell"))  # few rows: not hot
        shared = cells.where("NOT hot").withColumn("held", held).where("held > 1").drop("held").unionByName(cells.where("hot"))
        shared = scratch.store(shared)
        enough = scratch.store(shared.groupBy("sid").agg(F.count("*").alias("shares")).join(sizes, "sid"))
        here, left = enough.agg(F.count("*"), F.count_if(F.col("shares") >= F.col("need"))).first()
        cells = scratch.store(shared.join(enough.where("shares >= need").select("sid"), "sid", "left_semi"))
        if left >= (1 - ENDS) * here:
            return cells


def _meetings(scratch: Scratch, docs: DataFrame, sets: DataFrame, levels, width: int, num: int, den: int) -> DataFrame:
    """(cell, sid): the prefix shingles that several sets hold."""
    alive = scratch.store(_survivors(scratch, sets, num, den).select("sid").distinct())
    length = F.expr(f"cast(n - (n * {num} + {den - 1}) div {den} + 1 AS int)")
    cells = scratch.store(sets.join(alive, "sid").select("sid", F.explode(F.slice("prefix", F.lit(1), length)).alias("cell")))
    held = scratch.store(cells.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1"))
    if held.where(F.col("held") > CROWD).limit(1).count():
        elements = lambda some: _items(scratch, docs, sets, some, width).mapInArrow(_elements(levels), "sid long, n long, cell long, level short")
        some = scratch.store(cells.join(held.where(F.col("held") > CROWD).select("cell"), "cell", "left_semi").select("sid").distinct())
        common = scratch.store(elements(some).groupBy("cell").agg(F.count("*").alias("often")).where(F.col("often") > CROWD))
        some = scratch.store(some.unionByName(cells.join(common, "cell", "left_semi").select("sid")).distinct())
        unsigned = F.col("cell").bitwiseXOR(F.lit(-(2**63)))
        place = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "level", unsigned.alias("order"), "cell").alias("place")
        every = scratch.store(elements(some))
        ordered = spread_join(every, common, "cell", "left").select("sid", "n", place).groupBy("sid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("place")).alias("places"))  # one set each
        moved = ordered.select("sid", F.explode(F.slice("places", F.lit(1), length)).alias("place")).select("sid", "place.cell")
        cells = scratch.store(cells.join(some, "sid", "left_anti").unionByName(moved))
        held = scratch.store(cells.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1"))
    return scratch.store(spread_join(cells, held.select("cell"), "cell", counts=held).select("cell", "sid"))


# -- components


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round contracts every node into the smallest of its neighbours, which leaves at most half of
    the nodes of a component that has links, and only links between the nodes left go on.
    """
    edges = scratch.store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        tree = scratch.store(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("comp")))
        while True:
            up = tree.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
            jumped = scratch.store(spread_join(tree, up, "comp").select("node", F.col("beyond").alias("comp"), (F.col("beyond") != F.col("comp")).alias("moved")))
            tree = jumped.select("node", "comp")
            if not jumped.where("moved").limit(1).count():
                break
        steps.append(tree)
        once = scratch.store(spread_join(edges, tree.select(F.col("node").alias("a"), F.col("comp").alias("p")), "a").select("b", "p"))
        twice = spread_join(once, tree.select(F.col("node").alias("b"), F.col("comp").alias("q")), "b").where("p <> q")
        edges = scratch.store(twice.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    whole = steps[-1]
    for tree in reversed(steps[:-1]):
        whole = scratch.store(spread_join(tree, whole.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
    return whole


def merged(scratch: Scratch, comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (sid, comp; stored) after further ``links`` (a, b)."""
    name = lambda of, c: comps.select(F.col("sid").alias(of), F.col("comp").alias(c))
    links = scratch.store(links)
    once = scratch.store(spread_join(links, name("a", "p"), "a"))
    edges = spread_join(once, name("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    moved = connected(scratch, edges).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return scratch.store(spread_join(comps, moved, "comp", "left").select("sid", F.coalesce("to", "comp").alias("comp")))


# -- the join within a task


def _distances(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a set with others."""
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    at = np.minimum(np.searchsorted(pivot, items), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == items).astype(np.int64), np.cumsum(sizes) - sizes)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    items = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(items, kind="stable")
    items, rows = items[order], rows[order]
    starts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    held = np.diff(np.append(starts, len(items)))
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    column = np.repeat(np.arange(len(starts)), held)
    rare = (held[column] > 1) & (held[column] <= COMMON)
    r, c = rows[rare], column[rare]
    for step in range(1, COMMON):
        same = c[step:] == c[:-step]
        np.add.at(out, (r[:-step][same], r[step:][same]), 1)  # rows ascend within an element
    out += out.T
    common = np.flatnonzero(held > COMMON)
    for first in range(0, len(common), 2048):
        part = common[first : first + 2048]
        size = held[part]
        dense = np.zeros((m, len(part)), np.float32)
        at = np.repeat(starts[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
        dense[rows[at], np.repeat(np.arange(len(part)), size)] = 1
        out += (dense @ dense.T).astype(np.int64)
    return out


class Region:
    """Sets that one task joins; ``compared`` counts the pairs whose intersections were needed."""

    def __init__(self, sets: list[np.ndarray], comps: np.ndarray, num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.reach = (den - num) / den + 1e-9
        self.comp = np.unique(comps, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.compared = 0

    def link(self, i: int, j: int) -> None:
        if self.comp[i] != self.comp[j]:
            self.comp[self.comp == self.comp[j]] = self.comp[i]
            self.links.append((i, j))

    def linked(self, both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (left + right - both)

    def join(self, needed: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
        """Links that span all links of needed pairs, beyond the components given."""
        every = np.arange(len(self.sets))
        needed = np.ones((len(every),) * 2, bool) if needed is None else needed
        small, large = self.sizes[:, None], self.sizes[None, :]
        needed &= (self.num * small <= self.den * large) & (self.num * large <= self.den * small)
        np.fill_diagonal(needed, False)
        todo = [(every, needed, first)]
        while todo:
            members, needed, pivot = todo.pop()
            needed = needed & (self.comp[members][:, None] != self.comp[members][None, :])
            before = int(needed.sum())
            if not before:
                continue
            if len(members) <= LEAF:
                self._compare(members, needed)
                continue
            at = int(needed.sum(axis=1).argmax()) if pivot is None else int(np.flatnonzero(members == pivot)[0])
            both = _distances(self.sets[members[at]], [self.sets[i] for i in members])
            self.compared += len(members)
            own = self.sizes[members]
            for k in np.flatnonzero(self.linked(both, own, own[at]) & needed[at]):
                self.link(int(members[at]), int(members[k]))
            far = 1 - both / (own + own[at] - both)
            needed &= (np.abs(far[:, None] - far[None, :]) <= self.reach) & (self.comp[members][:, None] != self.comp[members][None, :])
            needed[at, :] = needed[:, at] = False
            for group in _groups(needed):
                part = needed[np.ix_(group, group)]
                if part.sum() > SHRINKS * before:
                    self._compare(members[group], part)
                else:
                    todo.append((members[group], part, None))
        return self.links

    def _compare(self, members: np.ndarray, needed: np.ndarray) -> None:
        pairs = np.argwhere(np.triu(needed, 1))
        self.compared += len(pairs)
        if len(pairs) > 4 * len(members):
            both = _overlaps([self.sets[i] for i in members])[pairs[:, 0], pairs[:, 1]]
        else:
            both = np.array([len(np.intersect1d(self.sets[members[i]], self.sets[members[j]], assume_unique=True)) for i, j in pairs], np.int64)
        own = self.sizes[members]
        for i, j in pairs[self.linked(both, own[pairs[:, 0]], own[pairs[:, 1]])]:
            self.link(int(members[i]), int(members[j]))


def _groups(needed: np.ndarray) -> Iterator[np.ndarray]:
    """The connected groups of two or more."""
    todo = needed.any(axis=1)
    while todo.any():
        frontier = [int(todo.argmax())]
        todo[frontier[0]] = False
        group = []
        while frontier:
            at = frontier.pop()
            group.append(at)
            near = np.flatnonzero(needed[at] & todo)
            todo[near] = False
            frontier += near.tolist()
        yield np.array(sorted(group))


def _joined(num: int, den: int):
    """Rows (task, region, i, j, side, ring, pivot, sid, comp, items) to spanning links (a, b)."""

    def join(rows: pd.DataFrame) -> list[tuple[int, int]]:
        names, side, far = rows["sid"].to_numpy(), rows["side"].to_numpy(), rows["far"].to_numpy(np.float64)
        region = Region([np.frombuffer(x, np.uint64) for x in rows["items"]], rows["comp"].to_numpy(), num, den)
        needed = None
        if not (side < 0).all():
            needed = np.abs(far[:, None] - far[None, :]) <= region.reach
            if rows["i"].iloc[0] != rows["j"].iloc[0]:
                needed &= side[:, None] != side[None, :]
        pivot = np.flatnonzero(names == rows["pivot"].iloc[0])
        return [(int(names[i]), int(names[j])) for i, j in region.join(needed, int(pivot[0]) if len(pivot) else None)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, rows in group.groupby(["region", "i", "j"], sort=False) for x in join(rows)]
        return pd.DataFrame(found, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    return run


# -- regions on the cluster


_FAR_ARROW = pa.schema([("region", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("pivot", pa.int64()), ("both", pa.int64()), ("total", pa.int64())])


def _measured(group: pd.DataFrame) -> pd.DataFrame:
    """Distances of the members of a part of a region to its pivots."""
    sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
    role = group["is_pivot"].to_numpy()
    members = np.flatnonzero(~role)
    out = []
    sizes = group["n"].to_numpy()[members]
    for at in np.flatnonzero(role) if len(members) else []:
        both = _distances(sets[at], [sets[i] for i in members])
        out.append(pd.DataFrame({"region": group["region"].iloc[0], "sid": group["sid"].to_numpy()[members], "n": sizes, "pivot": group["sid"].iloc[at], "both": both, "total": sizes + len(sets[at]) - both}))
    return pd.concat(out) if out else pd.DataFrame({f.name: np.zeros(0, np.int64) for f in _FAR_ARROW})


def _far_from_pivots(large: DataFrame, pivots: DataFrame, items: DataFrame) -> DataFrame:
    """(region, sid, n, pivot, both, total); large: (region, sid, n, size, elements), pivots: (region, pivot)."""
    parts = F.greatest(F.ceil(F.col("size") / TILE_MEMBERS), F.ceil(F.col("elements") / TILE_ELEMENTS)).cast("int")
    dealt = large.select("region", "sid", F.lit(False).alias("is_pivot"), F.pmod(F.xxhash64("sid"), parts).cast("int").alias("part"))
    sizes = large.groupBy("region").agg(F.first("size").alias("size"), F.first("elements").alias("elements"))
    copies = pivots.join(sizes, "region").select("region", F.col("pivot").alias("sid"), F.lit(True).alias("is_pivot"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    shipped = dealt.unionByName(copies).join(items, "sid")
    return shipped.groupBy("region", "part").applyInPandas(_measured, "region long, sid long, n long, pivot long, both long, total long")


def _in_tasks(rows: DataFrame, items: DataFrame, total: int, num: int, den: int, key: list[str]) -> DataFrame:
    """Links of regions or pairs of tiles, several in a task."""
    task = F.pmod(F.xxhash64(*key), F.lit(max(1, -(-total // GROUP_ELEMENTS))))
    shipped = rows.join(items.select("sid", "items"), "sid").withColumn("task", task)
    return shipped.groupBy("task").applyInPandas(_joined(num, den), "a long, b long")


def _ring_tiles(scratch: Scratch, stuck: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """Links within regions that no longer shrink; stuck: (region, sid, n, comp, far), stored."""
    stuck = scratch.store(stuck.withColumn("ring", F.floor(F.col("far") * den / (den - num))).withColumn("key", F.xxhash64("region", "ring")))
    rings = stuck.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    parts = F.greatest(F.ceil(F.col("size") * 2 / TILE_MEMBERS), F.ceil(F.col("elements") * 2 / TILE_ELEMENTS))
    main = stuck.groupBy("region", "comp").agg(F.count("*").alias("held")).groupBy("region").agg(F.max(F.struct("held", "comp")).alias("main"))
    dealt = spread_join(scratch.store(spread_join(stuck, rings.select("key", parts.alias("parts")), "key")), main, "region")
    # members of the largest component get tiles of their own, of which no two need be joined
    own = F.when(F.col("comp") == F.col("main.comp"), F.col("parts")).otherwise(0)
    members = scratch.store(dealt.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")) + own).drop("key", "main", "parts"))
    tiles = members.groupBy("region", "ring", "part").agg(F.sum("n").alias("elements"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    tiles = tiles.withColumn("tile", F.struct("ring", "part"))
    left, right = (tiles.select("region", *[F.col(c).alias(f"{c}{k}") for c in ("tile", "ring", "elements", "low", "high", "least", "most")]) for k in (1, 2))
    pairs = left.join(right, "region").where("tile1 <= tile2 AND ring2 <= ring1 + 1").where("NOT (low1 = high1 AND low2 = high2 AND low1 = low2)")
    pairs = scratch.store(pairs.where((F.col("least1") * num <= F.col("most2") * den) & (F.col("least2") * num <= F.col("most1") * den)).select("region", "tile1", "tile2", (F.col("elements1") + F.col("elements2")).alias("elements")))
    total = pairs.agg(F.sum("elements")).first()[0] or 0
    same = F.col("tile1") == F.col("tile2")
    sides = pairs.select("region", F.xxhash64("tile1").alias("i"), F.xxhash64("tile2").alias("j"), F.explode(F.when(same, F.array(F.struct(F.lit(0).alias("side"), F.col("tile1").alias("tile")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("tile1").alias("tile")), F.struct(F.lit(1).alias("side"), F.col("tile2").alias("tile"))))).alias("s"))
    sides = sides.select("region", "i", "j", "s.side", "s.tile.ring", "s.tile.part")
    rows = members.join(sides, ["region", "ring", "part"]).select("region", "i", "j", "side", "far", F.lit(0).cast("long").alias("pivot"), "sid", "comp")
    return _in_tasks(rows, items, total, num, den, ["region", "i", "j"])


def _region_links(scratch: Scratch, regions: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, comp) of the members of regions; regions: (region, sid, n), named by their pivots."""
    reach = (den - num) / den
    comps = scratch.store(items.select("sid", F.col("sid").alias("comp")))
    pivots = regions.select("region", F.col("region").alias("pivot")).distinct()
    turn = 0
    while True:
        turn += 1
        sizes = regions.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
        is_large = (F.col("size") > TILE_MEMBERS) | (F.col("elements") > TILE_ELEMENTS)
        sizes = scratch.store(sizes.where("size > 1").withColumn("large", is_large))
        placed = scratch.store(spread_join(regions, sizes, "region"))
        total = sizes.where("NOT large").agg(F.sum("elements")).first()[0] or 0
        small = spread_join(placed.where("NOT large"), comps, "sid").join(pivots.groupBy("region").agg(F.min("pivot").alias("pivot")), "region")
        zero = F.lit(0).cast("long")
        rows = small.select("region", zero.alias("i"), zero.alias("j"), F.lit(-1).alias("side"), F.lit(0.0).alias("far"), "pivot", "sid", "comp")
        links = _in_tasks(rows, items, total, num, den, ["region"])
        large = placed.where("large")
        if not sizes.where("large").limit(1).count():
            return merged(scratch, comps, links)

        own = pivots.join(sizes.where("large").select("region"), "region")
        more = [F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + k), "sid"), "sid")).sid.alias(f"p{k}") for k in range(1, PIVOTS)]
        chosen = large.groupBy("region").agg(*more).select("region", F.explode(F.array(*[f"p{k}" for k in range(1, PIVOTS)])).alias("pivot")) if more else own
        own = scratch.store(own.unionByName(chosen).distinct())
        far = scratch.store(_far_from_pivots(large, own, items))
        linked = F.col("both") * den >= F.col("total") * num
        comps = merged(scratch, comps, links.unionByName(far.where(linked).select(F.col("sid").alias("a"), F.col("pivot").alias("b"))))

        far = far.withColumn("far", 1 - F.col("both") / F.col("total"))
        home = far.groupBy("region", "sid").agg(F.min("far").alias("near"))
        cells = far.join(home, ["region", "sid"]).where(F.col("far") - F.col("near") <= 2 * reach + 1e-9)
        cells = scratch.store(cells.select("region", "sid", "n", "pivot", "far", F.xxhash64(F.lit(turn), "region", "pivot").alias("cell")))
        cells = scratch.store(spread_join(cells, comps, "sid"))
        cells = cells.join(own.join(comps.select(F.col("sid").alias("pivot"), F.col("comp").alias("of")), "pivot").select("region", "pivot", "of"), ["region", "pivot"])
        lowest = cells.where("comp <> of").groupBy("cell").agg(F.min("far").alias("lowest"))
        kept = scratch.store(spread_join(scratch.store(cells), lowest, "cell").where((F.col("comp") != F.col("of")) | (F.col("far") >= F.col("lowest") - reach - 1e-9)))
        left = kept.groupBy("region", "cell").agg(F.count("*").alias("left")).join(sizes.select("region", "size"), "region")
        stuck = left.where(F.col("left") > SHRINKS * F.col("size")).select("region").distinct()
        stuck = scratch.store(stuck)
        if stuck.limit(1).count():
            about = own.groupBy("region").agg(F.min("pivot").alias("pivot"))
            rows = far.join(about, ["region", "pivot"]).join(stuck, "region", "left_semi").join(kept.select("region", "sid").distinct(), ["region", "sid"], "left_semi")
            rows = scratch.store(spread_join(scratch.store(rows.select("region", "sid", "n", "far")), comps, "sid"))
            comps = merged(scratch, comps, _ring_tiles(scratch, rows, items, num, den))
            kept = scratch.store(kept.join(stuck, "region", "left_anti"))
        regions = kept.select(F.col("cell").alias("region"), "sid", "n")
        pivots = scratch.store(kept.groupBy(F.col("cell").alias("region")).agg(F.min(F.when(F.col("comp") != F.col("of"), F.col("sid"))).alias("pivot")))


def set_components(scratch: Scratch, docs: DataFrame, sets: DataFrame, levels, width: int, num: int, den: int) -> DataFrame:
    """(sid, comp) of the sets that meet others."""
    meetings = _meetings(scratch, docs, sets, levels, width, num, den)
    degrees = meetings.groupBy("sid").agg(F.count("*").alias("degree"))
    ranked = scratch.store(meetings.join(degrees, "sid").select("cell", "sid", F.struct("degree", "sid").alias("rank")))
    pivots = ranked.groupBy("cell").agg(F.max("rank").alias("pivot"))
    regions = scratch.store(spread_join(ranked.select("cell", "sid"), pivots, "cell").select(F.col("pivot.sid").alias("region"), "sid").distinct())
    items = _items(scratch, docs, sets, regions.select("sid").distinct(), width)
    regions = scratch.store(regions.join(items.select("sid", "n"), "sid"))
    return _region_links(scratch, regions, items, num, den)


def components(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (long)."""
    spark = docs.sparkSession
    num, den = similarity
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    found = rarity(docs, width)
    hot, levels = hot_level(found), spark.sparkContext.broadcast(found)
    with Scratch(spark, "jaccard") as scratch:
        named = docs.select("doc_id", "mark", "text").mapInArrow(_named(width, num, den, levels, hot), "doc_id long, mark long, n long, d binary, rare int, prefix array<long>")
        classes = scratch.store(named)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("first")
        grouped = classes.where("n > 0").groupBy("d").agg(first, F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
        sets = scratch.store(grouped.withColumn("sid", F.monotonically_increasing_id()))
        comps = set_components(scratch, docs, sets, levels, width, num, den)
        owned = scratch.store(sets.select("sid", "d", F.col("first.doc_id").alias("least")).join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")))
        lowest = owned.groupBy("comp").agg(F.min("least").alias("component_id"))
        final = scratch.store(spread_join(owned, lowest, "comp").select("d", "component_id"))
        linked = spread_join(classes.where("n > 0").select("doc_id", "n", "d"), final, "d").select("doc_id", "n", "component_id")
        alone = classes.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return store(linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "jaccard")


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> dict[int, tuple[int, int]]:
    """Plain Python over all pairs, for tests: id -> (set size, component)."""
    import re

    num, den = similarity
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    comp = {doc: doc for doc in sets}

    def root(x: int) -> int:
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {doc: (len(s), root(doc)) for doc, s in sets.items()}

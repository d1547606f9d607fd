"""The graph: ``nodes(node, value)`` and ``edges(src, label, dst)``, both sets.

A graph is a pair of DataFrames and never changes; operations return new graphs.  Saved graphs
are Parquet with the edges partitioned by label, so that a step of a path reads one label.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: In a graph's memo: its tables are files, which a plan over it reads and doesn't compute again.
STORED = "stored"

#: In a graph's memo: (graph it was made from, edges lost since or None, edges added since or None).
MADE_FROM = "made from"
#: Rows of a few short texts that every executor may hold for a join, so that the other side isn't moved.
HELD_ROWS = 2_000_000

NODES = "node string, value string"
EDGES = "src string, label string, dst string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  Where that is unset, a single
    machine gets a folder of this user's; a cluster gets an error, since executors' own disks aren't shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "grafwerk-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage through a table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of the driver's as part of the plan, which needs no tasks of its own."""
    columns = to_arrow_schema(StructType.fromDDL(schema))
    values = list(zip(*rows)) or [()] * len(columns)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, columns)], schema=columns))


def held(stored: DataFrame, bound: int = HELD_ROWS) -> DataFrame:
    """A stored table, to be held by every executor in joins if it has few rows."""
    return F.broadcast(stored) if stored.count() <= bound else stored


@dataclass(frozen=True, eq=False)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: Closures and plans that hold for this version of the graph.
    memo: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    # -- building

    @classmethod
    def of(cls, edges: DataFrame, values: DataFrame | None = None, isolated: DataFrame | None = None) -> Graph:
        """From edges (src, label, dst), values (node, value) and further nodes (node)."""
        edges = edges.select("src", "label", "dst").distinct()
        named = [edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node"))]
        named += [x.select("node") for x in (values, isolated) if x is not None]
        nodes = reduce(DataFrame.unionByName, named).distinct()
        if values is None:
            nodes = nodes.withColumn("value", F.lit(None).cast("string"))
        else:
            nodes = nodes.join(values.groupBy("node").agg(F.max("value").alias("value")), "node", "left")
        return cls(nodes, edges)

    @classmethod
    def from_triples(cls, spark: SparkSession, triples: Iterable[tuple[str, str, str]], values: dict[str, str] | None = None, isolated: Iterable[str] = ()) -> Graph:
        return cls.of(
            spark.createDataFrame(list(triples), EDGES),
            spark.createDataFrame(list((values or {}).items()), NODES),
            spark.createDataFrame([(n,) for n in isolated], "node string"),
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges").select("src", "label", "dst"), {STORED: True})

    def save(self, path: str, max_files_per_label: int = 64) -> None:
        """Parquet below ``path``; within a label, rows are dealt by a hash of the source, so a hot
        label is no single task."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        dealt = self.edges.repartition("label", F.pmod(F.xxhash64("src"), F.lit(max_files_per_label)))
        dealt.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")

    def settled(self) -> Graph:
        """The same graph read from stored tables; one that is read from such tables already is its own copy."""
        if self.memo.get(STORED):
            return self
        path = f"{shared_dir(self.spark)}/graph-{uuid.uuid4().hex}"
        self.save(path)
        return Graph.load(self.spark, path)

    def cached(self) -> Graph:
        return Graph(self.nodes.persist(), self.edges.persist())

    # -- reading

    def labelled(self, label: str) -> DataFrame:
        return self.edges.where(F.col("label") == label)

    def labels(self) -> DataFrame:
        return self.edges.select("label").distinct()

    def label_counts(self) -> DataFrame:
        return self.edges.groupBy("label").agg(F.count("*").alias("edges"))

    def with_value(self, value: str) -> DataFrame:
        return self.nodes.where(F.col("value") == value).select(F.col("node").alias("n"))

    def predecessors(self, label: str, targets: DataFrame | None = None) -> DataFrame:
        """n: sources of edges into ``targets`` (n), or of all edges of the label."""
        found = self.labelled(label)
        if targets is not None:
            found = found.join(targets, found["dst"] == targets["n"], "left_semi")
        return found.select(F.col("src").alias("n")).distinct()

    def successors(self, label: str, sources: DataFrame | None = None) -> DataFrame:
        found = self.labelled(label)
        if sources is not None:
            found = found.join(sources, found["src"] == sources["n"], "left_semi")
        return found.select(F.col("dst").alias("n")).distinct()

    def stats(self) -> DataFrame:
        """One row: nodes, edges, labels, valued_nodes."""
        of_nodes = self.nodes.agg(F.count("*").alias("nodes"), F.count("value").alias("valued_nodes"))
        of_edges = self.label_counts().agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.count("*").alias("labels"))
        return of_nodes.crossJoin(of_edges).select("nodes", "edges", "labels", "valued_nodes")  # two single rows

    def isolated_nodes(self) -> DataFrame:
        ends = self.edges.select(F.col("src").alias("node")).unionByName(self.edges.select(F.col("dst").alias("node")))
        return self.nodes.join(ends, "node", "left_anti").select(F.col("node").alias("n"))

    # -- changing

    def add_edges(self, edges: DataFrame) -> Graph:
        """What is known is looked up from the side of the new edges, so a few of them don't move the graph."""
        keys = ["src", "label", "dst"]
        new = edges.select(*keys).distinct()
        new = new.join(self.edges.join(new, keys, "left_semi").select(*keys), keys, "left_anti")
        ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        fresh = ends.join(self.nodes.join(ends, "node", "left_semi").select("node"), "node", "left_anti").withColumn("value", F.lit(None).cast("string"))
        return Graph(self.nodes.unionByName(fresh), self.edges.select(*keys).unionByName(new))

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """nodes: (node, value); known nodes keep their value unless it is null."""
        every = self.nodes.withColumn("old", F.lit(1)).unionByName(nodes.select("node", "value").withColumn("old", F.lit(0)))
        kept = every.groupBy("node").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("old"))).alias("value"))
        return Graph(kept, self.edges)

    def set_values(self, values: DataFrame) -> Graph:
        """values: (node, value); replaces."""
        kept = self.nodes.join(values.select("node"), "node", "left_anti").unionByName(values.select("node", "value"))
        return Graph(kept, self.edges)

    def remove_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(edges, ["src", "label", "dst"], "left_anti"))

    def remove_nodes(self, gone: DataFrame) -> Graph:
        """gone: (n); takes all their edges along."""
        kept = self.nodes.join(gone, self.nodes["node"] == gone["n"], "left_anti")
        src, dst = gone.select(F.col("n").alias("src")), gone.select(F.col("n").alias("dst"))
        edges = self.edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select("src", "label", "dst")
        return Graph(kept, edges, {MADE_FROM: (self, self.edges_of(gone), None)})

    def edges_of(self, nodes: DataFrame) -> DataFrame:
        """The edges with an end in nodes (n)."""
        one = nodes.select("n").distinct()
        marked = self.edges.join(one.select(F.col("n").alias("src"), F.lit(True).alias("from_one")), "src", "left")
        marked = marked.join(one.select(F.col("n").alias("dst"), F.lit(True).alias("to_one")), "dst", "left")
        return marked.where("from_one OR to_one").select("src", "label", "dst")

    def only_labels(self, allowed: Iterable[str]) -> Graph:
        """Edges of these labels; all nodes stay."""
        return Graph(self.nodes, self.edges.where(F.col("label").isin(*sorted(allowed))))

    # -- hashes: exact bytes of a sorted listing

    def content_hash(self, values: bool = False) -> str:
        """First 16 hex digits of the sha256 of the sorted edges as JSON; with ``values`` of an
        object of edges and values that is not ASCII-escaped.  Tasks sort, spell and pack the listing; the driver only
        unpacks and digests, a piece at a time."""
        digest = hashlib.sha256()

        def stream(df: DataFrame, ascii_only: bool) -> None:
            digest.update(b"[")
            packed = cut(df.mapInArrow(_listed(ascii_only), "part int, place long, size long, packed binary"), "listing")
            for i, row in enumerate(packed.orderBy("part", "place").toLocalIterator(prefetchPartitions=True)):
                digest.update(b", " if i else b"")
                digest.update(pa.decompress(row["packed"], row["size"], "zstd"))
            digest.update(b"]")

        edges = self.edges.select("src", "label", "dst").orderBy("src", "label", "dst")
        if not values:
            stream(edges, True)
        else:
            digest.update(b'{"edges": ')
            stream(edges, False)
            digest.update(b', "values": ')
            stream(self.nodes.where("value IS NOT NULL").select("node", "value").orderBy("node"), False)
            digest.update(b"}")
        return digest.hexdigest()[:16]


def _listed(ascii_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a sorted partition as JSON without the outer brackets, packed by batches: (part, place, size, packed)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(b for b in batches if b.num_rows):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            text = json.dumps(rows, ensure_ascii=ascii_only)[1:-1].encode()
            one = [pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, ["part", "place", "size", "packed"])

    return listed


def difference(before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:
    """(removed, added) edges.  Where ``after`` was made from ``before`` by removals only or by additions only, these
    are the changes themselves."""
    keys, lost, new, now = ["src", "label", "dst"], [], [], after
    while now is not before and MADE_FROM in now.memo:
        now, removed, added = now.memo[MADE_FROM]
        lost += [] if removed is None else [removed]
        new += [] if added is None else [added]
    if now is before and not (lost and new) and len(lost) < 2:
        none = before.edges.where(F.lit(False)).select(*keys)
        return reduce(DataFrame.unionByName, lost, none), reduce(DataFrame.unionByName, new, none)
    return compared(before, after)


def compared(before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:
    """(removed, added) edges, by comparing all."""
    keys = ["src", "label", "dst"]
    return before.edges.join(after.edges, keys, "left_anti"), after.edges.join(before.edges, keys, "left_anti")

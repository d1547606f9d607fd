"""Bounded neighbourhoods with the status of a change log, and sorted slices of a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.graph import Graph, cut

#: Hops, and nodes of a view.
HOPS, NODE_CAP = 2, 150
FRESH = "fresh:"


@dataclass(frozen=True)
class Neighbourhood:
    center: str
    #: (node, hop, value, fresh, status)
    nodes: DataFrame
    #: (src, label, dst, status)
    edges: DataFrame
    truncated: bool

    def to_dict(self) -> dict:
        return {
            "center": self.center,
            "truncated": self.truncated,
            "nodes": [r.asDict() for r in self.nodes.orderBy("node").collect()],  # at most the cap
            "edges": [r.asDict() for r in self.edges.orderBy("src", "label", "dst").collect()],
        }


def neighbourhood(graph: Graph, center: str, hops: int = HOPS, cap: int = NODE_CAP, log: DataFrame | None = None) -> Neighbourhood:
    """Nodes within ``hops`` steps in either direction, admitted hop by hop in id order up to the
    cap, and the edges between them.  Changed edges and nodes of ``log`` are part of the graph that is
    walked, with their status."""
    if hops < 0 or cap < 1:
        raise ValueError("hops must be at least 0 and the cap at least 1")
    edges = graph.edges.withColumn("status", F.lit(None).cast("string"))
    if log is not None:
        changed = log.where("src IS NOT NULL").select("src", "label", "dst", F.when(F.col("op") == "add_edge", "added").otherwise("deleted").alias("status"))
        edges = edges.unionByName(changed).groupBy("src", "label", "dst").agg(F.max("status").alias("status"))
    known = graph.nodes.select("node")
    if log is not None:
        known = known.unionByName(log.where("node IS NOT NULL").select("node"))
    if not known.where(F.col("node") == center).limit(1).count():
        raise KeyError(f"{center} is no node of the graph")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    reached: dict[str, int] = {center: 0}
    truncated, frontier = False, [center]
    for hop in range(1, hops + 1):
        room = cap - len(reached)
        if not frontier or room <= 0:
            break
        near = both.where(F.col("a").isin(frontier)).select("b").distinct().where(~F.col("b").isin(list(reached)))  # at most the cap
        found = [r[0] for r in near.orderBy("b").limit(room + 1).collect()]
        truncated |= len(found) > room
        frontier = found[:room]
        reached.update(dict.fromkeys(frontier, hop))
    spark = graph.spark
    inside = spark.createDataFrame(sorted(reached.items()), "node string, hop int")
    status = F.lit(None).cast("string").alias("status")
    nodes = inside.join(graph.nodes, "node", "left")
    if log is None:
        nodes = nodes.select("node", "hop", "value", F.col("node").startswith(FRESH).alias("fresh"), status)
    else:
        marked = log.where("node IS NOT NULL").groupBy("node").agg(F.max(F.when(F.col("op") == "add_node", "added").otherwise("deleted")).alias("status"))
        nodes = nodes.join(marked, "node", "left").select("node", "hop", "value", F.col("node").startswith(FRESH).alias("fresh"), "status")
    kept = edges.join(F.broadcast(inside.select(F.col("node").alias("src"))), "src", "left_semi").join(F.broadcast(inside.select(F.col("node").alias("dst"))), "dst", "left_semi")
    return Neighbourhood(center, nodes, kept.select("src", "label", "dst", "status"), truncated)


def sorted_slice(triples: DataFrame, seeds: list[str], cap: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(src, label, dst): breadth-first from the seeds in id order, cut after ``cap`` edges.

    triples: (src, label, dst, is_literal).  The order doesn't depend on the cap, so smaller slices
    are parts of larger ones.  Literals aren't followed.
    """
    spark = triples.sparkSession
    usable = triples.where(~F.col("label").isin(*exclude)) if exclude else triples
    usable = usable.select("src", "label", "dst", "is_literal").distinct()
    frontier = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "src string")
    visited, parts, taken = frontier, [], 0
    while taken < cap:
        ahead = cut(usable.join(frontier, "src", "left_semi").orderBy("src", "label", "dst").limit(cap - taken), "slice")
        found = ahead.count()
        if not found:
            break
        parts.append(ahead)
        taken += found
        frontier = cut(ahead.where(~F.col("is_literal")).select(F.col("dst").alias("src")).distinct().join(visited, "src", "left_anti"), "frontier")
        visited = visited.unionByName(frontier)
    out = spark.createDataFrame([], "src string, label string, dst string")
    for part in parts:
        out = out.unionByName(part.select("src", "label", "dst"))
    return out


def typing_completion(chosen: DataFrame, every: DataFrame, typing: tuple[str, ...]) -> DataFrame:
    """``chosen`` (src, label, dst) and all typing edges of ``every`` that its nodes lead to."""
    types = every.where(F.col("label").isin(*typing)).select("src", "label", "dst").distinct()
    ends = chosen.select(F.col("src").alias("n")).unionByName(chosen.select(F.col("dst").alias("n"))).distinct()
    seen = frontier = cut(ends, "typing")
    out = chosen
    while frontier.limit(1).count():
        step = cut(types.join(frontier.withColumnRenamed("n", "src"), "src", "left_semi"), "typing")
        out = out.unionByName(step)
        frontier = cut(step.select(F.col("dst").alias("n")).distinct().join(seen, "n", "left_anti"), "typing")
        seen = seen.unionByName(frontier)
    return out.distinct()


def label_index(graph: Graph, label_predicates: tuple[str, ...]) -> DataFrame:
    """(node, name): the value at the end of a node's first label edge in edge order."""
    named = graph.labelled(label_predicates[0]) if len(label_predicates) == 1 else graph.edges.where(F.col("label").isin(*label_predicates))
    values = graph.nodes.where("value IS NOT NULL").select(F.col("node").alias("dst"), "value")
    return named.join(values, "dst").groupBy(F.col("src").alias("node")).agg(F.min_by("value", F.struct("label", "dst")).alias("name"))


def top_in_degree(graph: Graph, k: int) -> DataFrame:
    """(node, in_degree) of the k nodes with most incoming edges."""
    return graph.edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "node").limit(k)


def rank_window(*by: str) -> Window:
    return Window.orderBy(*by)

"""Small measures over counts, rules and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph, difference


def wilson(hits: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(low, high) of a share; null without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p, z2 = hits / n, z * z
    center, spread = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return center - spread, center + spread


def per_thousand_edges(counts: DataFrame, graph: Graph) -> DataFrame:
    """Adds prevalence to (cid, witnesses)."""
    return counts.crossJoin(graph.edges.agg(F.count("*").alias("edges"))).withColumn("prevalence", F.when(F.col("edges") > 0, F.col("witnesses") * 1000 / F.col("edges")))  # one row


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cid, before, after, change) of two sets of counts (cid, witnesses)."""
    joined = before.select("cid", F.col("witnesses").alias("before")).join(after.select("cid", F.col("witnesses").alias("after")), "cid", "full")
    return joined.fillna(0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))


def overlap(a: Graph, b: Graph) -> DataFrame:
    """One row: edges in both, only in a, only in b, and their Jaccard similarity."""
    only_a, only_b = difference(a, b)
    row = a.edges.agg(F.count("*").alias("a")).crossJoin(only_a.agg(F.count("*").alias("only_a"))).crossJoin(only_b.agg(F.count("*").alias("only_b")))  # single rows
    both = F.col("a") - F.col("only_a")
    every = F.col("a") + F.col("only_b")
    return row.select(both.alias("both"), "only_a", "only_b", F.when(every > 0, both / every).alias("jaccard"))


def precision_recall(found: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """One row: hits, found, wanted, precision, recall, f1 of rule signatures."""
    hits = found.select(*on).distinct().join(wanted.select(*on).distinct(), on, "left_semi").agg(F.count("*").alias("hits"))
    row = hits.crossJoin(found.select(*on).distinct().agg(F.count("*").alias("found"))).crossJoin(wanted.select(*on).distinct().agg(F.count("*").alias("wanted")))  # single rows
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return row.withColumns({"precision": share("hits", "found"), "recall": share("hits", "wanted")}).withColumn("f1", 2 * F.col("hits") / F.when(F.col("found") + F.col("wanted") > 0, F.col("found") + F.col("wanted")))

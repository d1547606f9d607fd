"""Validation of arriving edges: each micro-batch is kept beside the graph, and the rules it touches are checked again.

Arrived edges are written by batch number beside the checkpoint, so a batch that is run again replaces itself and a
restarted stream goes on with all edges that came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grafwerk.graph import EDGES, Graph
from grafwerk.operators.validate import counts
from grafwerk.plans import ast
from grafwerk.rules import ConstraintSet


def touched_rules(rules: ConstraintSet, labels: set[str]) -> ConstraintSet:
    """Rules whose result edges of these labels can change."""
    return ConstraintSet(rules.name, [c for c in rules if (ast.labels(c.phi) | ast.labels(c.psi)) & labels])


def watch(edges: DataFrame, graph: Graph, rules: ConstraintSet, report: Callable[[int, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """edges: a stream of (src, label, dst).  Calls ``report`` with the batch's number and the
    counts (ord, cid, tier, witnesses) of the rules that it touches."""
    spark, folder = graph.spark, f"{checkpoint.rstrip('/')}-arrived"

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.select("src", "label", "dst").distinct().write.mode("overwrite").parquet(f"{folder}/batch={number}")
        arrived = spark.read.schema(f"{EDGES}, batch long").parquet(folder)
        labels = {r[0] for r in arrived.where(F.col("batch") == number).select("label").distinct().collect()}
        if labels:
            report(number, counts(graph.add_edges(arrived.where(F.col("batch") <= number)), touched_rules(rules, labels)))

    return edges.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

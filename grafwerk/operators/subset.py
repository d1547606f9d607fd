"""Repair by deletion: drop the witnesses of deletion rules until there are none.

A round takes the witnesses of all eligible rules at once.  The log's order is a set-based key: an
edge with two witnesses for ends belongs to the smaller one; the key is (owner, edges before the
node itself, label, outgoing before incoming, other end).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.graph import Graph, compared, cut, held, small_table
from grafwerk.operators.changes import LOG, records
from grafwerk.operators.validate import witnesses
from grafwerk.plans import ast
from grafwerk.rules import CORE, SUBSET, Constraint, ConstraintSet

#: More rounds than this are an error, not a loop without end.
MAX_ROUNDS = 1000
#: Rounds of changes that are kept beside the graph before it is written again.
COMPACT_ROUNDS = 8


@dataclass(frozen=True)
class SubsetRepairResult:
    """The log, the changes and the attestations are made when they are asked for."""

    graph: Graph
    #: (graph, gone (n, constraint), number) of each round.
    steps: tuple[tuple[Graph, DataFrame, int], ...]
    rounds: int
    recheck_count: int
    attest: Callable[[], dict[str, bool]]

    @cached_property
    def attestations(self) -> dict[str, bool]:
        return self.attest()

    @cached_property
    def log(self) -> DataFrame:
        none = small_table(self.graph.spark, [], LOG)
        return reduce(DataFrame.unionByName, [cut(round_log(*step), "log") for step in self.steps], none)

    def changes(self) -> DataFrame:
        """(round, op, constraint) of each record of the log, in no order."""
        none = small_table(self.graph.spark, [], "round int, op string, constraint string")
        return reduce(DataFrame.unionByName, [round_changes(graph, gone).select(F.lit(number).alias("round"), _op(), "constraint") for graph, gone, number in self.steps], none)

    @property
    def consistent_after(self) -> bool:
        return self.attestations["consistent_after"]

    def deleted(self) -> DataFrame:
        none = small_table(self.graph.spark, [], "n string")
        return reduce(DataFrame.unionByName, [gone.select("n") for _, gone, _ in self.steps], none)

    def to_dict(self, limit: int | None = None) -> dict:
        log = [r.to_dict() for r in records(self.log, limit)]
        return {"mode": "subset", "rounds": self.rounds, "recheck_count": self.recheck_count, "attest": self.attestations, "changelog": log, "deleted": sorted(r["node"] for r in log if r["op"] == "remove_node")}


def eligible(rules: Iterable[Constraint]) -> list[Constraint]:
    return [c for c in rules if c.tier == CORE and c.direction == SUBSET]


def flagged(graph: Graph, rules: list[Constraint]) -> DataFrame:
    """(n, constraint): each witness with the first rule that flags it."""
    return witnesses(graph, rules).groupBy("n").agg(F.min_by("cid", "ord").alias("constraint"))


def _op() -> Column:
    return F.when(F.col("last") == 1, "remove_node").otherwise("remove_edge").alias("op")


def round_changes(graph: Graph, gone: DataFrame) -> DataFrame:
    """What deleting ``gone`` (n, constraint) from ``graph`` changes, with the keys of the log's order."""
    src = gone.select(F.col("n").alias("src"), F.col("constraint").alias("by_src"))
    dst = gone.select(F.col("n").alias("dst"), F.col("constraint").alias("by_dst"))
    marked = graph.edges.join(src, "src", "left").join(dst, "dst", "left").where("by_src IS NOT NULL OR by_dst IS NOT NULL")
    outgoing = F.col("by_dst").isNull() | (F.col("by_src").isNotNull() & (F.col("src") <= F.col("dst")))
    edges = marked.select(
        F.when(outgoing, F.col("src")).otherwise(F.col("dst")).alias("owner"),
        F.when(outgoing, F.col("by_src")).otherwise(F.col("by_dst")).alias("constraint"),
        F.when(outgoing, 0).otherwise(1).alias("incoming"),
        F.when(outgoing, F.col("dst")).otherwise(F.col("src")).alias("other"),
        "src", "label", "dst", F.lit(None).cast("string").alias("node"), F.lit(0).alias("last"),
    )
    none = F.lit(None).cast("string")
    nodes = gone.select(F.col("n").alias("owner"), "constraint", F.lit(0).alias("incoming"), none.alias("other"), none.alias("src"), none.alias("label"), none.alias("dst"), F.col("n").alias("node"), F.lit(1).alias("last"))
    return edges.unionByName(nodes)


def round_log(graph: Graph, gone: DataFrame, number: int) -> DataFrame:
    """The log of deleting ``gone`` (n, constraint) from ``graph``."""
    none = F.lit(None).cast("string")
    ordered = _numbered(round_changes(graph, gone), ["owner", "last", "label", "incoming", "other"])
    return ordered.select(F.lit(number).alias("round"), "seq", _op(), "constraint", "node", "src", "label", "dst", none.alias("witness"), none.alias("provenance"))


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``seq`` (1, 2, ...) by the keys, which are unique.  Rows are dealt by ranges of all keys, so neither a hub
    nor a large round is one task; only the partitions' sizes are added up in order."""
    place = F.monotonically_increasing_id()  # partition and row within it
    dealt = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place), "numbered")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = dealt.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.withColumn("seq", (row + F.col("before") + 1).cast("long")).drop("place", "part", "before")


def subset_repair(graph: Graph, rules: ConstraintSet, strategy: str = "full", max_rounds: int = MAX_ROUNDS) -> SubsetRepairResult:
    """``incremental`` checks again only rules over labels of edges that the last round removed."""
    if strategy not in ("full", "incremental"):
        raise ValueError(f"unknown strategy {strategy!r}")
    own = eligible(rules)
    base = now = graph
    steps, lost, rounds, checked, due = [], None, 0, 0, own
    while True:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        checked += len(due)
        gone = cut(flagged(now, due), "gone") if due else None
        if gone is None or not gone.limit(1).count():
            break
        gone = held(gone)
        steps.append((now, gone, rounds))
        if strategy == "incremental":
            touched = {r[0] for r in now.edges_of(gone).select("label").distinct().collect()}
            due = [c for c in own if (ast.labels(c.phi) | ast.labels(c.psi)) & touched or _reads_all_nodes(c)]
        # the graph is the base without the nodes lost since; it is written again only every few rounds
        lost = gone.select("n") if lost is None else held(cut(lost.unionByName(gone.select("n")), "lost"))
        now = base.remove_nodes(lost)
        if rounds % COMPACT_ROUNDS == 0:
            base = now = now.settled()
            lost = None

    def attest() -> dict[str, bool]:
        removed, added = compared(graph, now)
        return {
            "consistent_after": not witnesses(now, own).limit(1).count(),
            "subset_only_deleted": not added.limit(1).count() and not now.nodes.join(graph.nodes, "node", "left_anti").limit(1).count(),
            "data_values_unmodified": not _changed_values(graph, now).limit(1).count(),
        }

    return SubsetRepairResult(now, tuple(steps), rounds, checked, attest)


def _reads_all_nodes(rule: Constraint) -> bool:
    """Node deletion alone can change what these select."""
    return any(isinstance(e, (ast.Top, ast.ValueEq)) for e in rule.psi.walk()) and not ast.labels(rule.psi)


def _changed_values(before: Graph, after: Graph) -> DataFrame:
    """Nodes of both graphs whose value differs."""
    old = before.nodes.select("node", F.col("value").alias("old"))
    return after.nodes.join(old, "node").where(~F.col("value").eqNullSafe(F.col("old")))

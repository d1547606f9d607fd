"""Repair by addition: instantiate each rule's plan for its witnesses until there are none.

A consequent is compiled once to a plan of a few steps over the witness, named constants and at most
two fresh nodes for a rule.  A round instantiates all plans for all witnesses and keeps the first
occurrence of each addition by (rule, witness, step).  Pruning then drops additions that the rest
makes redundant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.graph import MADE_FROM, Graph, compared, cut, held, small_table
from grafwerk.operators import prune as prune_plan
from grafwerk.operators.changes import LOG, records
from grafwerk.operators.subset import COMPACT_ROUNDS, _changed_values, _numbered
from grafwerk.operators.validate import witnesses
from grafwerk.plans import ast
from grafwerk.plans.local import LocalGraph
from grafwerk.rules import CORE, Constraint, ConstraintSet

#: Stands for the witness in a plan.
WITNESS = "\x00witness"
FRESH_PER_RULE = 2


class NoSupersetPlan(ValueError):
    """The consequent has no plan of additions."""


@dataclass(frozen=True)
class Step:
    """An addition: a node (with a value, if named) or an edge."""

    op: str
    provenance: str
    node: str | None = None
    value: str | None = None
    src: str | None = None
    label: str | None = None
    dst: str | None = None


@dataclass(frozen=True)
class AdditionPlan:
    steps: tuple[Step, ...]
    #: Values that every witness must have.
    required_values: tuple[str, ...]


class _Planner:
    def __init__(self, rule: Constraint):
        self.rule, self.steps, self.required, self.fresh = rule, [], [], {}

    def node(self, e: ast.Node, cursor: str) -> None:
        if isinstance(e, ast.Conj):
            self.node(e.left, cursor)
            self.node(e.right, cursor)
        elif isinstance(e, ast.Disj):
            self.node(e.left, cursor)
        elif isinstance(e, ast.ValueEq):
            self.demand(e.value, cursor)
        elif isinstance(e, ast.Has):
            self.path(ast.flatten(e.path), cursor)

    def demand(self, value: str, cursor: str) -> None:
        if cursor != WITNESS:
            raise NoSupersetPlan(f"{self.rule.cid}: a fresh node can't have the value {value!r}")
        self.required.append(value)

    def path(self, steps: list[ast.Path], cursor: str) -> None:
        for at, step in enumerate(steps):
            if isinstance(step, (ast.Eps, ast.Star)):
                continue
            if isinstance(step, ast.Test):
                if isinstance(step.node, ast.ValueEq):
                    self.demand(step.node.value, cursor)
                continue
            if not isinstance(step, (ast.Down, ast.Up)):
                raise NoSupersetPlan(f"{self.rule.cid}: no plan for {step}")
            pinned = self.pinned(steps[at + 1 :])
            other = pinned or self.allot("t" if isinstance(step, ast.Down) else "s")
            kind = "named" if pinned else "fresh"
            self.steps.append(Step("add_node", kind, node=other, value=pinned))
            ends = (cursor, other) if isinstance(step, ast.Down) else (other, cursor)
            self.steps.append(Step("add_edge", kind, src=ends[0], label=step.label, dst=ends[1]))
            if pinned:
                return
            cursor = other

    @staticmethod
    def pinned(rest: list[ast.Path]) -> str | None:
        """The value that the next node must have, if the path says so before its next hop."""
        for step in rest:
            if isinstance(step, ast.Test) and isinstance(step.node, ast.ValueEq):
                return step.node.value
            if not isinstance(step, (ast.Eps, ast.Star, ast.Test)):
                return None
        return None

    def allot(self, slot: str) -> str:
        if slot not in self.fresh:
            if len(self.fresh) == FRESH_PER_RULE:
                raise NoSupersetPlan(f"{self.rule.cid}: more than {FRESH_PER_RULE} fresh nodes")
            self.fresh[slot] = f"fresh:{self.rule.cid}:{len(self.fresh)}"
        return self.fresh[slot]


def plan(rule: Constraint) -> AdditionPlan:
    planner = _Planner(rule)
    planner.node(rule.psi, WITNESS)
    return AdditionPlan(tuple(planner.steps), tuple(dict.fromkeys(planner.required)))


@dataclass(frozen=True)
class SupersetRepairResult:
    """The sizes of the pool and the attestations are made when they are asked for."""

    graph: Graph
    log: DataFrame
    rounds: int
    pruned_edges: int
    pruned_nodes: int
    #: "grouped", "replayed", "inconsistent" or "off".
    pruning: str
    sizes: Callable[[], dict[str, int]]
    attest: Callable[[], dict[str, bool]]

    @cached_property
    def pool(self) -> dict[str, int]:
        """Sizes of the pool of values that additions are drawn from."""
        return self.sizes()

    @cached_property
    def attestations(self) -> dict[str, bool]:
        return self.attest()

    @property
    def consistent_after(self) -> bool:
        return self.attestations["consistent_after"]

    def added_edges(self) -> DataFrame:
        return self.log.where("op = 'add_edge'").select("src", "label", "dst")

    def added_nodes(self) -> DataFrame:
        return self.log.where("op = 'add_node'").select("node", "provenance")

    def to_dict(self, limit: int | None = None) -> dict:
        return {"mode": "superset", "rounds": self.rounds, "pruned_edges": self.pruned_edges, "pruned_nodes": self.pruned_nodes, "pool": self.pool, "pruning": self.pruning, "attest": self.attestations, "changelog": [r.to_dict() for r in records(self.log, limit)]}


def core(rules: Iterable[Constraint]) -> list[Constraint]:
    return [c for c in rules if c.tier == CORE]


def round_plan(graph: Graph, rules: list[Constraint], found: DataFrame) -> DataFrame:
    """All additions for the witnesses (cid, n) that ``graph`` lacks, each where it first occurs:
    (cid, witness, step, op, node, value, src, label, dst, provenance)."""
    spark, plans = graph.spark, {r.cid: plan(r) for r in rules}
    for cid, p in plans.items():
        if p.required_values:
            values = graph.nodes.select(F.col("node").alias("n"), "value")
            wrong = found.where(F.col("cid") == cid).join(values, "n").where(" OR ".join(f"NOT (value <=> '{v}')" for v in (x.replace("'", "\\'") for x in p.required_values)))
            if wrong.limit(1).count():
                raise NoSupersetPlan(f"{cid}: a witness can't be given another value")
    template = small_table(
        spark,
        [(cid, i, s.op, s.node, s.value, s.src, s.label, s.dst, s.provenance) for cid, p in plans.items() for i, s in enumerate(p.steps)],
        "cid string, step int, op string, node string, value string, src string, label string, dst string, provenance string",
    )
    put = lambda c: F.when(F.col(c) == WITNESS, F.col("n")).otherwise(F.col(c)).alias(c)
    made = found.select("cid", "n").join(F.broadcast(template), "cid")  # a few rows a rule
    made = made.select("cid", F.col("n").alias("witness"), "step", "op", put("node"), "value", put("src"), "label", put("dst"), "provenance")
    place = F.struct("cid", "witness", "step")
    first = lambda df, keys, rest: df.groupBy(*keys).agg(F.min(F.struct(place.alias("place"), *rest)).alias("f")).select(*keys, "f.place.*", *[f"f.{r}" for r in rest])
    nodes = cut(first(made.where("op = 'add_node'"), ["node"], ["value", "provenance"]), "new-nodes")
    edges = cut(first(made.where("op = 'add_edge'"), ["src", "label", "dst"], ["provenance"]), "new-edges")
    # what is known is looked up from the side of the additions, and only among their labels
    new_nodes, new_edges, keys = held(nodes.select("node")), held(edges.select("src", "label", "dst")), ["src", "label", "dst"]
    own = sorted({s.label for p in plans.values() for s in p.steps if s.op == "add_edge"})
    known = graph.edges.where(F.col("label").isin(*own)).join(new_edges, keys, "left_semi").select(*keys)
    nodes = nodes.join(graph.nodes.join(new_nodes, "node", "left_semi").select("node"), "node", "left_anti")
    edges = edges.join(known, keys, "left_anti")
    none = F.lit(None).cast("string")
    columns = ["cid", "witness", "step", "op", "node", "value", "src", "label", "dst", "provenance"]
    nodes = nodes.withColumns({"op": F.lit("add_node"), "src": none, "label": none, "dst": none}).select(*columns)
    return nodes.unionByName(edges.withColumns({"op": F.lit("add_edge"), "node": none, "value": none}).select(*columns))


def apply_plan(graph: Graph, additions: DataFrame) -> Graph:
    """``additions`` are new and distinct, and the ends of new edges are known or new nodes."""
    nodes, edges = additions.where("op = 'add_node'").select("node", "value"), additions.where("op = 'add_edge'").select("src", "label", "dst")
    return Graph(graph.nodes.unionByName(nodes), graph.edges.select("src", "label", "dst").unionByName(edges), {MADE_FROM: (graph, None, edges)})


def round_bound(graph: Graph, rules: list[Constraint]) -> int:
    """Rounds after which a repair has gone wrong: every productive round adds something from a finite pool."""
    return 100 + 10 * len(rules) + graph.nodes.count()


def pool_sizes(graph: Graph, rules: list[Constraint], log: DataFrame) -> dict[str, int]:
    """The values in the graph, the constants that rules name, and the fresh nodes used and allowed."""
    constants = {c for r in rules for c in ast.constants(r.phi) | ast.constants(r.psi)}
    fresh = log.where("op = 'add_node' AND provenance = 'fresh'").select("node").distinct()
    return {"graph_values": graph.nodes.select("value").where("value IS NOT NULL").distinct().count(), "named_constants": len(constants), "fresh_used": fresh.count(), "fresh_bound": FRESH_PER_RULE * len(rules)}


def superset_repair(graph: Graph, rules: ConstraintSet, prune: bool = True, max_rounds: int | None = None) -> SupersetRepairResult:
    """Rounds go on to the fixpoint.  Raises RuntimeError past ``max_rounds`` (see ``round_bound``) and
    NoSupersetPlan where a failing rule has no plan; ends without consistency where plans add nothing."""
    spark, own = graph.spark, core(rules)
    now, log, rounds = graph, small_table(spark, [], LOG), 0
    most, consistent = max_rounds, False
    while True:
        rounds += 1
        if most is None and rounds > 100:
            most = round_bound(graph, own)
        if most is not None and rounds > most:
            raise RuntimeError(f"no fixpoint after {most} rounds")
        found = cut(witnesses(now, own).select("cid", "n"), "found")
        if not found.limit(1).count():
            consistent = True
            break
        failing = {r[0] for r in found.select("cid").distinct().collect()}
        part = cut(round_plan(now, [r for r in own if r.cid in failing], found), "additions")
        if not part.limit(1).count():
            break
        numbered = _numbered(part.withColumn("pair", F.struct("cid", "witness")), ["pair", "step"])
        log = log.unionByName(numbered.select(F.lit(rounds).alias("round"), "seq", "op", F.col("cid").alias("constraint"), "node", "src", "label", "dst", "witness", "provenance"))
        now = apply_plan(now, part)
        if rounds % COMPACT_ROUNDS == 0:
            now, log = now.settled(), cut(log, "log")
    log = cut(log, "log")
    pruned, bare, how = 0, 0, "off"
    if prune and not consistent:
        how = "inconsistent"
    elif prune:
        now, log, pruned, bare, how = _prune(now, log, own)

    def attest() -> dict[str, bool]:
        removed, _ = compared(graph, now)
        return {
            "consistent_after": not witnesses(now, own).limit(1).count(),
            "superset_only_added": not removed.limit(1).count() and not graph.nodes.join(now.nodes, "node", "left_anti").limit(1).count(),
            "data_values_unmodified": not _changed_values(graph, now).limit(1).count(),
        }

    return SupersetRepairResult(now, log, rounds, pruned, bare, how, lambda: pool_sizes(graph, own, log), attest)


def _replayed(candidates: list[tuple], edges: list[tuple], after: Graph, rules: list[Constraint]) -> list[tuple[str, str, str]]:
    """The edges that can go, one by one in order, on a copy of the edges that rules read."""
    constants = sorted({c for r in rules for c in ast.constants(r.phi) | ast.constants(r.psi)})
    nodes = {n for s, _, d in edges for n in (s, d)}
    values: dict[str, str | None] = dict.fromkeys(nodes)
    values.update((r["node"], r["value"]) for r in after.nodes.where(F.col("value").isin(*constants)).collect())
    local, gone = LocalGraph(edges, values), []
    for _, _, src, label, dst in candidates:
        edge = (src, label, dst)
        local.remove(edge)
        if any(local.node(r.phi) - local.node(r.psi) for r in rules):
            local.add(edge)
        else:
            gone.append(edge)
    return gone


def _prune(after: Graph, log: DataFrame, rules: list[Constraint]) -> tuple[Graph, DataFrame, int, int, str]:
    """Greedy by (round, rule, source, label, target) over all added edges: an edge goes if every core
    rule still holds.  Rules that read added edges by their first hops only are pruned on the cluster
    (see prune); any other rule set is replayed on the driver, whatever its size.
    """
    added = log.where("op = 'add_edge'").select(*prune_plan.ORDER)
    try:
        lost, how = prune_plan.redundant(added, after, rules), "grouped"
    except prune_plan.NotLocal:
        used = sorted({x for r in rules for x in ast.labels(r.phi) | ast.labels(r.psi)})
        # an edge that no rule reads can go at any time; of these, only the added ones matter
        read = after.edges.where(F.col("label").isin(*used)).collect()
        rows = sorted(tuple(r) for r in added.collect())
        gone = _replayed(rows, [tuple(r) for r in read], after, rules)
        lost, how = small_table(after.spark, gone, "src string, label string, dst string"), "replayed"
    lost = cut(lost, "lost")
    count = lost.count()
    if not count:
        return after, log, 0, 0, how
    kept = after.remove_edges(lost)
    ends = kept.edges.select(F.col("src").alias("node")).unionByName(kept.edges.select(F.col("dst").alias("node")))
    idle = log.where("op = 'add_node'").select("node").join(ends, "node", "left_anti").distinct()
    idle = cut(idle, "idle")
    kept = Graph(kept.nodes.join(idle, "node", "left_anti"), kept.edges).settled()
    edges_left = log.where("op = 'add_edge'").join(lost, ["src", "label", "dst"], "left_anti")
    nodes_left = log.where("op = 'add_node'").join(idle, "node", "left_anti")
    columns = [c.split()[0] for c in LOG.split(", ")]
    return kept, edges_left.select(*columns).unionByName(nodes_left.select(*columns)), count, idle.count(), how

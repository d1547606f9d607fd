"""Validation: the witnesses of all rules in one plan, and reports over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.graph import Graph, small_table
from grafwerk.plans import ast
from grafwerk.plans.compile import Compiler
from grafwerk.rules import TIERS, Constraint, ConstraintSet

WITNESSES = "ord int, cid string, tier string, n string"


def check(graph: Graph, rule: Constraint) -> DataFrame:
    """n: nodes of the antecedent that aren't in the consequent."""
    compiler = Compiler(graph)
    if isinstance(rule.psi, ast.Top):
        return graph.nodes.where(F.lit(False)).select(F.col("node").alias("n"))
    return compiler.node(rule.phi).join(compiler.node(rule.psi), "n", "left_anti")


def witnesses(graph: Graph, rules: Iterable[Constraint]) -> DataFrame:
    """(ord, cid, tier, n) of all rules as one plan; rules that can't fail add nothing."""
    parts = [
        check(graph, r).select(F.lit(i).alias("ord"), F.lit(r.cid).alias("cid"), F.lit(r.tier).alias("tier"), "n")
        for i, r in enumerate(rules)
        if not isinstance(r.psi, ast.Top)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else small_table(graph.spark, [], WITNESSES)


def counts(graph: Graph, rules: ConstraintSet) -> DataFrame:
    """(ord, cid, tier, witnesses); rules without a witness have 0."""
    found = witnesses(graph, rules).groupBy("ord").agg(F.count("*").alias("witnesses"))
    table = rules.to_df(graph.spark).select("ord", "cid", "tier")
    return table.join(found, "ord", "left").select("ord", "cid", "tier", F.coalesce("witnesses", F.lit(0)).alias("witnesses"))


def counts_by_tier(graph: Graph, rules: ConstraintSet) -> DataFrame:
    """(tier, witnesses) of both tiers."""
    tiers = small_table(graph.spark, [(t,) for t in TIERS], "tier string")
    found = counts(graph, rules).groupBy("tier").agg(F.sum("witnesses").alias("witnesses"))
    return tiers.join(found, "tier", "left").select("tier", F.coalesce("witnesses", F.lit(0)).alias("witnesses"))


def preview(found: DataFrame, limit: int) -> DataFrame:
    """(ord, cid, tier, rank, n): the first witnesses of each rule by id; all if limit is negative."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy("n")))
    return (ranked if limit < 0 else ranked.where(F.col("rank") <= limit)).select("ord", "cid", "tier", "rank", "n")


@dataclass(frozen=True)
class Violation:
    constraint: Constraint
    count: int
    witnesses: tuple[str, ...]


@dataclass(frozen=True)
class ValidationReport:
    """What the driver keeps of a validation: counts, and as many witnesses as asked for."""

    violations: tuple[Violation, ...]

    @property
    def total_witnesses(self) -> int:
        return sum(v.count for v in self.violations)

    @property
    def consistent(self) -> bool:
        return not self.total_witnesses

    def failing(self) -> list[Violation]:
        return [v for v in self.violations if v.count]

    def by_tier(self) -> dict[str, int]:
        return {t: sum(v.count for v in self.violations if v.constraint.tier == t) for t in TIERS}

    def to_dict(self) -> dict:
        rows = [
            {"cid": v.constraint.cid, "kind": v.constraint.kind, "tier": v.constraint.tier, "direction": v.constraint.direction, "violations": v.count, "witnesses": list(v.witnesses)}
            for v in self.violations
        ]
        return {"consistent": self.consistent, "total_witnesses": self.total_witnesses, "by_tier": self.by_tier(), "constraints": rows}

    def summary(self) -> str:
        head = "consistent" if self.consistent else f"{self.total_witnesses} witnesses in {len(self.failing())} of {len(self.violations)} rules"
        return "\n".join([head, *(f"  {v.constraint.cid} [{v.constraint.tier}]: {v.count}" for v in self.failing())])


def validate(graph: Graph, rules: ConstraintSet, witness_limit: int = 10) -> ValidationReport:
    """Counts of all rules in one job, then the first witnesses of the rules that fail.  A negative limit asks
    for all witnesses, which the driver then holds."""
    count_of = {r["ord"]: r["witnesses"] for r in witnesses(graph, rules).groupBy("ord").agg(F.count("*").alias("witnesses")).collect()}
    names: dict[int, list[str]] = {}
    if count_of and witness_limit:
        failing = [(i, c) for i, c in enumerate(rules) if i in count_of]
        shown = preview(witnesses(graph, [c for _, c in failing]), witness_limit).select("ord", "rank", "n")
        for row in sorted(shown.collect(), key=lambda r: (r["ord"], r["rank"])):  # witness_limit rows a rule
            names.setdefault(failing[row["ord"]][0], []).append(row["n"])
    return ValidationReport(tuple(Violation(c, count_of.get(i, 0), tuple(names.get(i, ()))) for i, c in enumerate(rules)))

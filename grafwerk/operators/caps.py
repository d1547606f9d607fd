"""The safety cap before a repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph
from grafwerk.operators.validate import witnesses
from grafwerk.rules import CORE, SUBSET, ConstraintSet

#: The largest share of nodes to delete, and of edges to add.
DELETION_CAP, ADDITION_CAP = 0.20, 0.30


@dataclass(frozen=True)
class CapDecision:
    mode: str
    fraction: float
    cap: float

    @property
    def allowed(self) -> bool:
        return self.fraction <= self.cap

    @property
    def status(self) -> str:
        return "ok" if self.allowed else "ABORTED-BY-CAP"

    def to_dict(self) -> dict:
        return {"mode": self.mode, "fraction": round(self.fraction, 6), "cap": self.cap, "status": self.status}


def deletion_fraction(graph: Graph, rules: ConstraintSet) -> DataFrame:
    """One row: witnesses of deletion rules (each node once), nodes, fraction."""
    found = witnesses(graph, [c for c in rules if c.tier == CORE and c.direction == SUBSET]).agg(F.countDistinct("n").alias("affected"))
    total = graph.nodes.agg(F.count("*").alias("total"))
    return _fraction(found, total)


def addition_fraction(graph: Graph, rules: ConstraintSet) -> DataFrame:
    """One row: witnesses of core rules (summed over rules), edges, fraction."""
    found = witnesses(graph, rules.core()).agg(F.count("n").alias("affected"))
    total = graph.edges.agg(F.count("*").alias("total"))
    return _fraction(found, total)


def _fraction(found: DataFrame, total: DataFrame) -> DataFrame:
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("affected") / F.when(F.col("total") == 0, 1).otherwise(F.col("total")))
    return found.crossJoin(total).select("affected", "total", share.alias("fraction"))  # two single rows


def check_cap(graph: Graph, rules: ConstraintSet, mode: str, cap: float | None = None) -> CapDecision:
    """Refuses only what is over the cap."""
    if mode not in ("subset", "superset"):
        raise ValueError(f"unknown mode {mode!r}")
    measured = (deletion_fraction if mode == "subset" else addition_fraction)(graph, rules).first()
    default = DELETION_CAP if mode == "subset" else ADDITION_CAP
    return CapDecision(mode, float(measured["fraction"]), default if cap is None else cap)

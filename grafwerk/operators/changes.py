"""The change log of a repair as a DataFrame and as records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row a change, in log order by (round, seq).
LOG = "round int, seq long, op string, constraint string, node string, src string, label string, dst string, witness string, provenance string"


@dataclass(frozen=True)
class ChangeRecord:
    op: str
    round: int
    constraint: str
    node: str | None = None
    src: str | None = None
    label: str | None = None
    dst: str | None = None
    witness: str | None = None
    provenance: str | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in vars(self).items() if v is not None}


def records(log: DataFrame, limit: int | None = None) -> list[ChangeRecord]:
    """The log's records in order; ``limit`` bounds what the driver holds."""
    rows = log.orderBy("round", "seq")
    rows = rows.limit(limit) if limit is not None else rows
    return [ChangeRecord(r["op"], r["round"], r["constraint"], r["node"], r["src"], r["label"], r["dst"], r["witness"], r["provenance"]) for r in rows.collect()]


def change_counts(log: DataFrame) -> DataFrame:
    """(op, constraint, n)."""
    return log.groupBy("op", "constraint").agg(F.count("*").alias("n"))

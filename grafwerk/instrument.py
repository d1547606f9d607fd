"""Run records: phases, memory and outcome of a run as one JSON line; summaries over them."""

from __future__ import annotations

import hashlib
import json
import resource
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafwerk.graph import Graph
from grafwerk.rules import ConstraintSet

#: Fields of a record and their types.
FIELDS = {"run_id": str, "timestamp": str, "code_revision": str, "config_hash": str, "status": str, "slice": dict, "constraints": dict, "mode": str, "timings_s": dict, "wall_total_s": float, "repair": dict, "resources": dict, "attestations": dict}


def config_hash(config: object) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def code_revision() -> str:
    """A hash over the package's sources."""
    digest = hashlib.sha256()
    for path in sorted(Path(__file__).parent.rglob("*.py")):
        digest.update(path.read_bytes())
    return digest.hexdigest()[:16]


def graph_meta(graph: Graph, source: str) -> dict:
    row = graph.stats().first()
    return {"source": source, "V": row["nodes"], "E": row["edges"], "labels": row["labels"], "data_values": row["valued_nodes"]}


class RunContext:
    """Collects a record and appends it when the run ends, failed or not."""

    def __init__(self, path: str | Path, slice_: dict, rules: ConstraintSet, mode: str, config: object = None):
        self.path = Path(path)
        self.record = {
            "run_id": uuid.uuid4().hex, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "code_revision": code_revision(), "config_hash": config_hash(config),
            "status": "running", "slice": slice_, "constraints": rules.coverage(), "mode": mode, "timings_s": {}, "wall_total_s": 0.0, "repair": {}, "resources": {}, "attestations": {},
        }

    def __enter__(self) -> RunContext:
        self._began = time.perf_counter()
        return self

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record["timings_s"][name] = time.perf_counter() - began

    def repaired(self, before: Graph, after: Graph, rounds: int, attestations: dict) -> None:
        a, b = before.stats().first(), after.stats().first()
        self.record["repair"] = {"rounds": rounds, "nodes_before": a["nodes"], "nodes_after": b["nodes"], "edges_before": a["edges"], "edges_after": b["edges"]}
        self.record["attestations"] = attestations

    def __exit__(self, kind, error, trace) -> None:
        self.record["status"] = "ok" if kind is None else f"error: {kind.__name__}"
        self.record["wall_total_s"] = time.perf_counter() - self._began
        self.record["resources"] = {"peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as out:
            out.write(json.dumps(self.record, sort_keys=True) + "\n")


def check_record(record: dict) -> list[str]:
    """What is wrong with a record."""
    return [f"{k}: {type(record.get(k)).__name__}, not {t.__name__}" for k, t in FIELDS.items() if not isinstance(record.get(k), t)]


def timing_summary(spark: SparkSession, path: str) -> DataFrame:
    """(mode, E, wall_total_s): the latest good run of each mode and size."""
    runs = spark.read.json(path).where("status = 'ok'")
    latest = Window.partitionBy("mode", "slice.E").orderBy(F.desc("timestamp"))
    ranked = runs.withColumn("rank", F.row_number().over(latest)).where("rank = 1")
    return ranked.select("mode", F.col("slice.E").alias("E"), "wall_total_s").orderBy("mode", "E")


def text_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *[[str(r[n]) for n in names] for r in rows]]
    width = [max(len(c[i]) for c in cells) for i in range(len(names))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(c, width)).rstrip() for c in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])

"""The public surface in one place."""

from __future__ import annotations

import os
from collections.abc import Iterable

from grafwerk import __version__
from grafwerk.bundle import diff_lines, parse_diff, reverse, write_bundle, zip_bundle
from grafwerk.candidates import Candidate, CandidateFile, candidate_cid, merge, seal, seal_holds, set_status
from grafwerk.catalogue import compile_all, export_json, get, registry, synthetic_rules
from grafwerk.graph import Graph, difference
from grafwerk.instrument import RunContext, check_record, graph_meta, text_table, timing_summary
from grafwerk.operators.caps import CapDecision, check_cap
from grafwerk.operators.changes import ChangeRecord, change_counts, records
from grafwerk.operators.metrics import GraphMetrics, compare_metrics, compute_metrics, metric_names, metrics_block, split_type_predicates
from grafwerk.operators.neighbourhood import label_index, neighbourhood, sorted_slice, typing_completion
from grafwerk.operators.search import SearchConfig, search
from grafwerk.operators.shape_rules import ShapeResult, reduced_cover, shape_rules, validates_clean
from grafwerk.operators.shapes import detect_vocabulary
from grafwerk.operators.subset import SubsetRepairResult, subset_repair
from grafwerk.operators.superset import NoSupersetPlan, SupersetRepairResult, superset_repair
from grafwerk.operators.validate import ValidationReport, check, counts, validate, witnesses
from grafwerk.plans.compile import evaluate
from grafwerk.plans.parser import ExpressionError, NegationRefused, parse_node, parse_path
from grafwerk.propose import deferred_impact, derive, fill_impact, gloss, measure_impact
from grafwerk.review import GateError, attestations, reviewed_rules
from grafwerk.rules import Constraint, ConstraintSet
from grafwerk.sources.ntriples import NTriplesError, from_lines, read_ntriples, write_ntriples
from grafwerk.sources.turtle import AllowList, RawCache, looks_foreign, read_facts
from grafwerk.synth import generate

__all__ = [
    "AllowList", "Candidate", "CandidateFile", "CapDecision", "ChangeRecord", "Constraint", "ConstraintSet", "ExpressionError", "GateError", "Graph", "GraphMetrics", "NTriplesError", "NegationRefused",
    "NoSupersetPlan", "RawCache", "RunContext", "SearchConfig", "ShapeResult", "SubsetRepairResult", "SupersetRepairResult", "ValidationReport", "attestations", "candidate_cid", "change_counts", "check", "check_cap",
    "check_record", "compare_metrics", "compile_all", "compute_metrics", "counts", "deferred_impact", "derive", "detect_vocabulary", "diff_lines", "difference", "envelope", "evaluate", "export_json", "fill_impact", "from_lines", "generate",
    "get", "gloss", "graph_meta", "label_index", "looks_foreign", "measure_impact", "merge", "metric_names", "metrics_block", "neighbourhood", "parse_diff", "parse_node", "parse_path", "read_facts", "read_ntriples", "records", "registry",
    "reduced_cover", "reverse", "reviewed_rules", "seal", "seal_holds", "search", "set_status", "shape_rules", "sorted_slice", "split_type_predicates", "subset_repair", "superset_repair", "synthetic_rules", "text_table", "timing_summary",
    "typing_completion", "validate", "validates_clean", "witnesses", "write_bundle", "write_ntriples", "zip_bundle",
]


def envelope(command: str, rules_from: str, graph_path: str, type_predicates: Iterable[str], dropped: int | None = None) -> dict:
    """What surrounds a result in a report: no clock and no absolute path."""
    out = {"tool_version": __version__, "subcommand": command, "constraints_source": rules_from, "input_basename": os.path.basename(graph_path), "type_predicates": sorted(type_predicates), "allowlist_applied": dropped is not None}
    return out if dropped is None else out | {"allowlist_edges_dropped": dropped}

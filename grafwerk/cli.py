"""Command line: check, repair, metrics, derive, review."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from grafwerk import api, catalogue
from grafwerk.candidates import ACCEPTED, REJECTED, WEAKENED, CandidateFile
from grafwerk.graph import Graph
from grafwerk.rules import CORE, ConstraintSet
from grafwerk.sources.ntriples import TYPE_PREDICATES

#: Exit codes.
OK, USAGE, VIOLATIONS, CAPPED, REFUSED = 0, 1, 2, 3, 4
NO_CANDIDATES, REVIEW_PENDING = 3, 2


class UsageError(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="grafwerk", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--in", dest="graph", required=True)
    common.add_argument("--constraints")
    common.add_argument("--domain")
    common.add_argument("--kg", default="wikidata")
    common.add_argument("--version", type=int, default=1)
    common.add_argument("--type-predicate", action="append")
    common.add_argument("--allowlist")
    common.add_argument("--report")
    common.add_argument("--indent", type=int, default=2)
    check = commands.add_parser("check", parents=[common])
    check.add_argument("--witness-limit", type=int, default=10)
    repair = commands.add_parser("repair", parents=[common])
    repair.add_argument("--mode", choices=("subset", "superset"), required=True)
    repair.add_argument("--out")
    repair.add_argument("--bundle")
    repair.add_argument("--zip", action="store_true")
    repair.add_argument("--max-deletion-fraction", type=float)
    repair.add_argument("--max-addition-fraction", type=float)
    repair.add_argument("--no-prune", action="store_true")
    repair.add_argument("--strategy", choices=("full", "incremental"), default="full")
    repair.add_argument("--allow-graph-drift", action="store_true")
    commands.add_parser("metrics", parents=[common])
    derive = commands.add_parser("derive")
    for flag in ("--in", "--out"):
        derive.add_argument(flag, dest="graph" if flag == "--in" else "out", required=True)
    derive.add_argument("--domain", default="derived")
    derive.add_argument("--kg", default="kg")
    derive.add_argument("--reference")
    derive.add_argument("--min-support", type=int, default=5)
    derive.add_argument("--min-conf", type=float, default=0.9)
    derive.add_argument("--delta", type=float)
    derive.add_argument("--max-antecedent", type=int, default=2)
    derive.add_argument("--max-path", type=int, default=1)
    derive.add_argument("--generator", choices=("search", "shape"), default="search")
    derive.add_argument("--measure", action="store_true")
    derive.add_argument("--type-predicate", action="append")
    review = commands.add_parser("review")
    review.add_argument("path")
    review.add_argument("--reviewer")
    review.add_argument("--graph")
    return top


def _rules(args: argparse.Namespace) -> tuple[ConstraintSet | CandidateFile, str]:
    if args.constraints:
        data = json.loads(Path(args.constraints).read_text(encoding="utf-8"))
        found = CandidateFile.from_dict(data) if "candidates" in data else ConstraintSet.from_dict(data).compile_all()
        return found, Path(args.constraints).name
    if args.domain:
        return catalogue.get(args.domain, args.kg, args.version), f"builtin:{args.domain}/{args.kg}"
    raise UsageError("give --constraints or --domain")


def _graph(spark: SparkSession, args: argparse.Namespace) -> tuple[Graph, list[str], int | None]:
    types = args.type_predicate or list(TYPE_PREDICATES)
    graph = api.read_ntriples(spark, args.graph, types)
    dropped = None
    if args.allowlist:
        kept = graph.only_labels(api.AllowList.read(args.allowlist).predicates)
        dropped = graph.edges.count() - kept.edges.count()
        graph = kept
    return graph.settled(), types, dropped


def _emit(args: argparse.Namespace, payload: dict) -> None:
    text = json.dumps(payload, indent=args.indent, sort_keys=True) + "\n"
    Path(args.report).write_text(text, encoding="utf-8") if args.report else sys.stdout.write(text)


def _check(spark: SparkSession, args: argparse.Namespace) -> int:
    rules, source = _rules(args)
    graph, types, dropped = _graph(spark, args)
    if isinstance(rules, CandidateFile):
        rules = api.reviewed_rules(rules, graph, for_repair=False)
    found = api.validate(graph, rules, args.witness_limit)
    _emit(args, api.envelope("check", source, args.graph, types, dropped) | {"result": found.to_dict()})
    return VIOLATIONS if found.by_tier()[CORE] else OK


def _metrics(spark: SparkSession, args: argparse.Namespace) -> int:
    rules, source = _rules(args) if args.constraints or args.domain else (None, "none")
    graph, types, dropped = _graph(spark, args)
    if isinstance(rules, CandidateFile):
        rules = api.reviewed_rules(rules, graph, for_repair=False)
    halves = api.split_type_predicates(args.type_predicate)
    _emit(args, api.envelope("metrics", source, args.graph, types, dropped) | {"result": api.compute_metrics(graph, rules, *halves).to_dict()})
    return OK


def _repair(spark: SparkSession, args: argparse.Namespace) -> int:
    rules, source = _rules(args)
    graph, types, dropped = _graph(spark, args)
    gate = None
    if isinstance(rules, CandidateFile):
        gate = api.attestations(rules, args.allow_graph_drift)
        rules = api.reviewed_rules(rules, graph, args.allow_graph_drift)
    cap = api.check_cap(graph, rules, args.mode, args.max_deletion_fraction if args.mode == "subset" else args.max_addition_fraction)
    payload = api.envelope("repair", source, args.graph, types, dropped) | {"mode": args.mode, "cap": cap.to_dict()} | ({"review": gate} if gate else {})
    if not cap.allowed:
        _emit(args, payload)
        if args.bundle:
            api.write_bundle(args.bundle, payload, rules=rules)
        return CAPPED
    result = api.subset_repair(graph, rules, args.strategy) if args.mode == "subset" else api.superset_repair(graph, rules, not args.no_prune)
    payload |= {"result": result.to_dict(), "metrics": api.metrics_block(graph, result.graph, rules), "output_basename": Path(args.out).name if args.out else None}
    _emit(args, payload)
    if args.out:
        api.write_ntriples(result.graph, args.out)
    if args.bundle:
        api.write_bundle(args.bundle, payload, result.graph, graph, rules)
        if args.zip:
            api.zip_bundle(args.bundle)
    return OK if result.consistent_after else VIOLATIONS


def _derive(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda path: api.read_ntriples(spark, path, args.type_predicate or TYPE_PREDICATES).settled()
    graph = read(args.graph)
    found = api.detect_vocabulary(graph)
    if found is None:
        return NO_CANDIDATES
    cfg = api.SearchConfig(args.min_support, args.min_conf, args.max_antecedent, args.max_path, type_predicate=found.type_predicate, subclass_predicate=found.subclass_predicate)
    file = api.derive(graph, args.domain, args.kg, cfg, read(args.reference) if args.reference else None, args.delta, Path(args.graph).name, args.generator, args.measure)
    if Path(args.out).exists():
        file = api.merge(CandidateFile.read(args.out), file)
    if not file.candidates:
        return NO_CANDIDATES
    file.write(args.out)
    return OK


def _review(spark: SparkSession, args: argparse.Namespace, read_line: Callable[[str], str] = input) -> int:
    """a(ccept), w(eaken), r(eject) with an optional note, s(kip), q(uit); then the seal."""
    file = CandidateFile.read(args.path)
    words = {"a": ACCEPTED, "w": WEAKENED, "r": REJECTED}
    for c in [c for c in file.ordered_for_review() if c.status == "pending"]:
        answer = read_line(f"{c.cid} [{c.kind}]\n  {c.antecedent}\n  implies {c.consequent}\n  {c.evidence}\na/w/r/s/q> ").strip()
        if answer[:1] == "q":
            break
        if answer[:1] in words:
            api.set_status(file, c.cid, words[answer[:1]], answer[1:].strip())
            file.write(args.path)
    if file.pending():
        return REVIEW_PENDING
    if args.reviewer and not file.sealed:
        api.seal(file, args.reviewer)
    file.write(args.path)
    return OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None, read_line: Callable[[str], str] = input) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    try:
        if args.command == "review":
            return _review(spark, args, read_line)
        spark = spark or SparkSession.builder.appName("grafwerk").getOrCreate()
        return {"check": _check, "repair": _repair, "metrics": _metrics, "derive": _derive}[args.command](spark, args)
    except api.GateError as e:
        print(e, file=sys.stderr)
        return REFUSED
    except (UsageError, api.ExpressionError, api.NoSupersetPlan, OSError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())

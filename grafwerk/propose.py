"""Mined rules as a candidate file for review, and what accepting one would do."""

from __future__ import annotations

import re

from grafwerk import __version__
from grafwerk.candidates import Candidate, CandidateFile, candidate_cid
from grafwerk.graph import Graph
from grafwerk.operators import search, shape_rules
from grafwerk.operators.subset import subset_repair
from grafwerk.operators.superset import NoSupersetPlan, superset_repair
from grafwerk.operators.validate import validate
from grafwerk.rules import CORE, SUPERSET, Constraint, ConstraintSet

WITNESSES = 3
SEARCH, SHAPE = "search", "shape"

#: How a rule of each kind reads.
GLOSSES = {
    "existential_domain": "anything with an outgoing {predicate} edge should be {a_class}",
    "existential_range": "anything on the receiving end of a {predicate} edge should be {a_class}",
    "typing_existence": "anything matching this pattern should be {a_class}",
    "requires_statement": "everything that is {a_class} should have an outgoing {predicate} edge",
    "weakening": "everything that is {a_class} should have an outgoing {predicate} edge, or match the broader alternative recorded with this entry",
}


def gloss(kind: str, cls: str | None, predicate: str | None, labels: dict[str, str] | None = None) -> str:
    """A sentence for a reviewer; classes and predicates by their labels where there are any."""
    named = lambda term, none: (labels or {}).get(term, term) if term else none
    if kind not in GLOSSES:
        return f"a derived {kind.replace('_', ' ')} rule"
    return GLOSSES[kind].format(a_class=named(cls, "of the expected type"), predicate=named(predicate, "the expected"))


def deferred_impact(witnesses: int | None = None) -> dict:
    """An impact whose two repairs haven't been run."""
    return {"witnesses": witnesses, "subset_deletions": None, "superset_additions": None, "measured": False}


def measure_impact(graph: Graph, rule: Constraint) -> dict:
    """Both repairs with this rule alone: the nodes that go and the edges that come.  A repair that can't act on the
    rule leaves its number empty and a note."""
    alone = ConstraintSet(f"candidate@{rule.cid}", [rule])
    out = deferred_impact(validate(graph, alone, 0).total_witnesses) | {"measured": True}
    runs = {"subset": ("deletions", lambda: subset_repair(graph, alone).deleted()), "superset": ("additions", lambda: superset_repair(graph, alone).added_edges())}
    for mode, (what, run) in runs.items():
        try:
            out[f"{mode}_{what}"] = run().count()
        except (NoSupersetPlan, RuntimeError) as stopped:
            out[f"{mode}_note"] = f"{type(stopped).__name__}: {stopped}"
    return out


def fill_impact(graph: Graph, candidate: Candidate, force: bool = False) -> dict:
    """The candidate's impact, measured now unless it has been."""
    if force or not candidate.impact.get("measured"):
        candidate.impact = measure_impact(graph, Constraint(candidate.cid, candidate.antecedent, candidate.consequent, "", "", candidate.kind, candidate.tier, "mined", candidate.direction))
    return candidate.impact


def _kind(body: str, head: str, wide: bool) -> str:
    if wide:
        return "weakening"
    if "val(" not in head:
        return "requires_statement"
    return {"d_": "existential_domain", "u_": "existential_range"}.get(body[:2], "typing_existence") if search.AND not in body else "typing_existence"


def _searched(graph: Graph, domain: str, kg: str, cfg: search.SearchConfig, labels: dict[str, str]) -> list[Candidate]:
    result = search.search(graph, cfg)
    rows = [(r["body"], r["head"], r["support"], r["denominator"], r["confidence"], False) for r in result.ordered().collect()]
    for r in result.widenings.orderBy("body", "head").collect():
        rows.append((r["body"], f"{r['head']} | {search.atom_text(r['atom'], cfg)}", r["support"], r["denominator"], r["confidence"], True))
    out = []
    for body, head, support, judged, confidence, wide in rows:
        text, kind = search.body_text(body, cfg), _kind(body, head, wide)
        evidence = {"support": support, "denominator": judged, "confidence": round(confidence, 6), "low_trust": kind == "requires_statement"}
        cls, predicate = _terms(text, head, kind)
        out.append(Candidate(candidate_cid(domain, kg, text, head), kind, CORE, SUPERSET, text, head, gloss(kind, cls, predicate, labels), evidence))
    return out


def _terms(antecedent: str, consequent: str, kind: str) -> tuple[str | None, str | None]:
    """The class and the predicate that a rule is about."""
    sides = (consequent, antecedent) if kind not in ("requires_statement", "weakening") else (antecedent, consequent)
    value, step = re.search(r'val\("([^"]+)"\)', sides[0]), re.search(r"(?:down|up)\(([^)]+)\)", sides[1])
    return value and value[1], step and step[1]


def _shaped(graph: Graph, domain: str, kg: str, cfg: search.SearchConfig, labels: dict[str, str]) -> list[Candidate]:
    result, out = shape_rules.shape_rules(graph, domain, kg, cfg), []
    for rule, facts in zip(result.rules, result.report):
        evidence = {"support": facts["support"], "denominator": facts["body_size"], "confidence": facts["pca_conf"]} | {k: facts[k] for k in ("low_trust", "exceptions", "contamination", "runner_up_classes")}
        cid = candidate_cid(domain, kg, rule.antecedent, rule.consequent)
        out.append(Candidate(cid, rule.kind, CORE, rule.direction, rule.antecedent, rule.consequent, gloss(rule.kind, facts["class"], facts["predicate"], labels), evidence))
    return out


def derive(graph: Graph, domain: str, kg: str, cfg: search.SearchConfig | None = None, reference: Graph | None = None, delta: float | None = None, dataset: str = "", generator: str = SEARCH, measure: bool = False, labels: dict[str, str] | None = None) -> CandidateFile:
    """Rules of the search or of the shapes, with evidence and a witness sample, ordered by witnesses x doubt.
    ``measure`` runs both repairs for each rule; else ``fill_impact`` does when it is asked for."""
    if cfg is None:
        cfg = shape_rules.detected(graph, search.SearchConfig())
    if generator not in (SEARCH, SHAPE):
        raise ValueError(f"unknown generator {generator!r}")
    out = (_searched if generator == SEARCH else _shaped)(graph, domain, kg, cfg, labels or {})
    rules = ConstraintSet(dataset or "derived", [Constraint(c.cid, c.antecedent, c.consequent, domain, kg, c.kind, CORE, "derived", c.direction) for c in out])
    report = {v.constraint.cid: v for v in validate(graph, rules, WITNESSES).violations} if out else {}
    other = _reference_scores(reference, rules, {c.cid: c.evidence["confidence"] for c in out}, cfg, delta) if reference is not None and delta is not None else {}
    kept = []
    for c, rule in zip(out, rules):
        seen = report[c.cid]
        c.impact = measure_impact(graph, rule) if measure else deferred_impact(seen.count)
        c.witness_sample = [(labels or {}).get(n, n) for n in seen.witnesses]
        if c.cid in other:
            c.evidence["stability"] = other[c.cid]
        if c.evidence.get("stability", {}).get("outcome") != "unstable":
            kept.append(c)
    order = sorted(kept, key=lambda c: (-c.impact["witnesses"] * (1 - c.evidence["confidence"]), c.cid))
    file = CandidateFile({"domain": domain, "kg": kg, "dataset": dataset, "content_hash": graph.content_hash()}, vars(cfg) | {"generator": generator}, candidates=kept, toolkit_version=__version__)
    file.review["review_order"] = [c.cid for c in order]
    return file


def _reference_scores(reference: Graph, rules: ConstraintSet, confidence: dict[str, float], cfg: search.SearchConfig, delta: float) -> dict[str, dict]:
    """Three outcomes for each rule: stable, unstable, or nothing to compare with."""
    floor, out = cfg.reference_support or cfg.min_support, {}
    texts = {c.cid: (c.antecedent, f"({c.antecedent}) & ({search.lead(c.psi)})", f"({c.antecedent}) & ({search.lead(c.psi)}) & ({c.consequent})") for c in rules}
    ext = search.extensions(reference, sorted({t for three in texts.values() for t in three}), "text")
    size = {r["text"]: r["count"] for r in ext.groupBy("text").count().collect()}
    for c in rules:
        body, judged, held = (size.get(t, 0) for t in texts[c.cid])
        if body < floor or not judged:
            out[c.cid] = {"outcome": "not_comparable", "confidence_ref": None}
        else:
            gap = abs(confidence[c.cid] - held / judged)
            out[c.cid] = {"outcome": "stable" if gap <= delta else "unstable", "confidence_ref": round(held / judged, 6), "gap": round(gap, 6)}
    return out

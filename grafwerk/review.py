"""The gate between candidate files and repairs."""

from __future__ import annotations

from grafwerk.candidates import CandidateFile, seal_holds
from grafwerk.graph import Graph
from grafwerk.plans.parser import ExpressionError
from grafwerk.rules import BOUNDARY, Constraint, ConstraintSet


class GateError(Exception):
    """A refusal; ``code`` says which."""

    code = "E-GATE"

    def __init__(self, message: str, cid: str | None = None):
        super().__init__(f"{self.code}: {message}")
        self.cid = cid


class SchemaRejected(GateError):
    code = "E-SCHEMA"


class NotSealed(GateError):
    code = "E-UNSEALED"


class ReviewIncomplete(GateError):
    code = "E-PENDING"


class SealMismatch(GateError):
    code = "E-SEAL"


class SourceDrift(GateError):
    code = "E-DRIFT"


class NothingAccepted(GateError):
    code = "E-EMPTY"


class BoundaryNotRepairable(GateError):
    code = "E-BOUNDARY"


class OutOfFragment(GateError):
    code = "E-FRAGMENT"


def reviewed_rules(file: CandidateFile, graph: Graph | None = None, allow_drift: bool = False, for_repair: bool = True) -> ConstraintSet:
    """The accepted rules of a file that passes every check, in the order of the checks."""
    if file.schema is None:
        raise SchemaRejected("the file has no schema")
    if file.authored and (file.review.get("seal") or file.sealed):
        raise SchemaRejected("an authored file carries no seal")
    if not file.authored and not file.sealed:
        raise NotSealed("a reviewer must decide on every candidate and seal the file")
    if file.pending():
        raise ReviewIncomplete(f"{len(file.pending())} candidates are still pending", file.pending()[0].cid)
    if not file.authored:
        if not seal_holds(file):
            raise SealMismatch("the file was changed after it was sealed")
        recorded = file.source.get("content_hash")
        if graph is not None and recorded and not allow_drift and (now := graph.content_hash()) != recorded:
            raise SourceDrift(f"the rules come from a graph with hash {recorded}; this one has {now}")
    if not file.accepted():
        raise NothingAccepted("no candidate was accepted")
    out = ConstraintSet(f"reviewed@{file.source.get('dataset', 'unknown')}")
    for c in file.accepted():
        if for_repair and c.tier == BOUNDARY:
            raise BoundaryNotRepairable(f"{c.cid} is reported only", c.cid)
        rule = Constraint(c.cid, c.antecedent, c.consequent, file.source.get("domain", "derived"), file.source.get("kg", "derived"), c.kind, c.tier, file.provenance, c.direction, c.note or c.gloss)
        try:
            out.add(rule.compile())
        except ExpressionError as e:
            raise OutOfFragment(f"{c.cid}: {e}", c.cid) from e
    return out


def attestations(file: CandidateFile, allow_drift: bool = False) -> dict:
    """What a report says about where its rules come from."""
    return {
        "provenance": file.provenance, "reviewer": file.review.get("reviewer"), "sealed_at": file.review.get("sealed_at"), "seal": file.review.get("seal"),
        "source_hash": file.source.get("content_hash"), "graph_drift_allowed": allow_drift, "accepted": len(file.accepted()), "refused": len(file.refused),
    }

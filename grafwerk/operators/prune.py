"""Greedy pruning of added edges as a distributed plan, equal to trying them one by one.

An edge goes if every rule still holds without it; edges are tried in the order (round, rule, source,
label, target).  Each side of a rule becomes a formula over atoms of a node: sets that no added edge
can change, and single hops over a label with added edges into such a set.  So an edge concerns its
two ends only, and a node's formulas need no more than which atoms hold by known edges and how many
undecided edges stand for the others.

First, edges whose outcome no other outcome can change are settled, all at once and a few times.  The
rest falls into groups (components over the nodes where a rule could still fail), which can't
influence each other: each is replayed in order by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph, cut, held, small_table
from grafwerk.plans import ast
from grafwerk.plans.compile import Compiler
from grafwerk.rules import Constraint

ORDER = ["round", "constraint", "src", "label", "dst"]
#: Rounds of settling edges at once; what is left then is replayed.
SETTLING_ROUNDS = 4


class NotLocal(ValueError):
    """A rule reads labels of added edges beyond its first hop."""


class Formulas:
    """Rules as trees of ('and' | 'or', left, right) and ('atom', number)."""

    def __init__(self, rules: Iterable[Constraint], changing: set[str]):
        self.changing = changing
        #: (kind, expression): 'set' with a node expression, or (label, outgoing, rest) of a hop.
        self.atoms: list[tuple] = []
        self.rules = list(dict.fromkeys((self.node(r.phi), self.node(r.psi)) for r in rules))

    def atom(self, *key) -> tuple:
        if key not in self.atoms:
            self.atoms.append(key)
        return ("atom", self.atoms.index(key))

    def node(self, e: ast.Node) -> tuple:
        if not ast.labels(e) & self.changing:
            return self.atom("set", e)
        if isinstance(e, (ast.Conj, ast.Disj)):
            return ("and" if isinstance(e, ast.Conj) else "or", self.node(e.left), self.node(e.right))
        return self.path(ast.flatten(e.path))

    def path(self, steps: list[ast.Path]) -> tuple:
        first, rest = steps[0], steps[1:]
        after = ast.Has(ast.sequence(*rest)) if rest else None
        if isinstance(first, ast.Eps):
            return self.node(after)
        if isinstance(first, ast.Test):
            return ("and", self.node(first.node), self.node(after)) if rest else self.node(first.node)
        if isinstance(first, ast.Alt):
            return ("or", *(self.node(ast.Has(ast.sequence(*ast.flatten(side), *rest))) for side in (first.left, first.right)))
        if not isinstance(first, (ast.Down, ast.Up)) or (after and ast.labels(after) & self.changing):
            raise NotLocal(str(first))
        return self.atom("hop", (first.label, isinstance(first, ast.Down), after))


def holds(f: tuple, true: Callable[[int], bool]) -> bool:
    if f[0] == "atom":
        return true(f[1])
    return holds(f[1], true) and holds(f[2], true) if f[0] == "and" else holds(f[1], true) or holds(f[2], true)


def _column(f: tuple, true: Callable[[int], Column]) -> Column:
    if f[0] == "atom":
        return true(f[1])
    left, right = _column(f[1], true), _column(f[2], true)
    return left & right if f[0] == "and" else left | right


def _facts(after: Graph, candidates: DataFrame, formulas: Formulas) -> DataFrame:
    """(n, atom, e) of the nodes that an added edge concerns: the added edge e stands for the atom,
    or (e null) it holds anyway."""
    compiler, hops, sets = Compiler(after), [], []
    places = {(label, outgoing) for kind, what in formulas.atoms if kind == "hop" for label, outgoing, _ in [what]}
    # facts of other nodes than those that an added edge can concern aren't needed, whatever their label
    ends = [candidates.where(F.col("label") == label).select(F.col("src" if outgoing else "dst").alias("n")) for label, outgoing in sorted(places)]
    near_added = held(cut(reduce(DataFrame.unionByName, ends).distinct(), "near-added")) if ends else None
    marked = after.edges.join(candidates.select("src", "label", "dst", "e"), ["src", "label", "dst"], "left")
    for i, (kind, what) in enumerate(formulas.atoms):
        if kind == "set":
            sets.append(compiler.node(what).select("n", F.lit(i).alias("atom"), F.lit(None).cast("long").alias("e")))
            continue
        label, outgoing, rest = what
        near, far = ("src", "dst") if outgoing else ("dst", "src")
        found = marked.where(F.col("label") == label).select(F.col(near).alias("n"), F.col(far).alias("far"), "e")
        if rest is not None:
            found = found.join(compiler.node(rest).select(F.col("n").alias("far")), "far", "left_semi")
        hops.append(found.join(near_added, "n", "left_semi").select("n", F.lit(i).alias("atom"), "e"))
    if not hops:
        return small_table(after.spark, [], "n string, atom int, e long")
    read = cut(reduce(DataFrame.unionByName, hops), "hops")
    concerned = read.where("e IS NOT NULL").select("n").distinct()
    return cut(reduce(DataFrame.unionByName, [read, *sets]).join(concerned, "n", "left_semi").distinct(), "facts")


def _states(facts: DataFrame, atoms: int) -> DataFrame:
    """(n, k0.., c0..): whether each atom holds by known edges, and the undecided edges for it."""
    known = [F.coalesce(F.bool_or((F.col("atom") == i) & F.col("e").isNull()), F.lit(False)).alias(f"k{i}") for i in range(atoms)]
    counts = [F.count_if((F.col("atom") == i) & F.col("e").isNotNull()).alias(f"c{i}") for i in range(atoms)]
    return facts.groupBy("n").agg(*known, *counts)


def _least(i: int) -> Column:
    return F.col(f"k{i}")


def _most(i: int) -> Column:
    return F.col(f"k{i}") | (F.col(f"c{i}") > 0)


def _most_without(i: int) -> Column:
    return F.col(f"k{i}") | (F.col(f"c{i}") > F.col(f"o{i}").cast("long"))


def _any(rules: list[tuple], phi: Callable[[int], Column], psi: Callable[[int], Column]) -> Column:
    """Whether some rule's antecedent holds and its consequent doesn't."""
    return reduce(Column.__or__, (_column(a, phi) & ~_column(b, psi) for a, b in rules))


def _verdicts(facts: DataFrame, formulas: Formulas) -> DataFrame:
    """(e, needed, open): needed whatever becomes of the others; neither needed nor open: redundant."""
    atoms = len(formulas.atoms)
    own = facts.where("e IS NOT NULL").groupBy("e", "n").agg(*[F.bool_or(F.col("atom") == i).alias(f"o{i}") for i in range(atoms)])
    seen = own.join(_states(facts, atoms), "n")
    needed, maybe = _any(formulas.rules, _least, _most_without), _any(formulas.rules, _most_without, _least)
    return seen.select("e", needed.alias("needed"), maybe.alias("open")).groupBy("e").agg(F.bool_or("needed").alias("needed"), F.bool_or("open").alias("open"))


def _groups(links: DataFrame) -> DataFrame:
    """(e, c): the same c for edges that ``links`` (e, n) connects."""
    comp = cut(links.select("e", F.col("e").alias("c")).distinct(), "groups")
    while True:
        lowest = links.join(comp, "e").groupBy("n").agg(F.min("c").alias("m"))
        nearer = links.join(lowest, "n").groupBy("e").agg(F.min("m").alias("c"))
        jump = nearer.join(comp.select(F.col("e").alias("c"), F.col("c").alias("root")), "c").select("e", F.least("c", "root").alias("c"))
        now = cut(jump, "groups")
        if not now.join(comp.withColumnRenamed("c", "old"), "e").where("c <> old").limit(1).count():
            return now
        comp = now


def replay(rows: Iterable[tuple], known: dict[str, set[int]], rules: list[tuple]) -> list[int]:
    """The edges that go, of ``rows`` (order, e, n, atom), tried in order."""
    reads: dict[tuple, list[tuple[str, int]]] = {}
    counts: Counter = Counter()
    for order, e, n, atom in rows:
        reads.setdefault((order, e), []).append((n, atom))
        counts[n, atom] += 1
    gone = []
    for key in sorted(reads):
        for place in reads[key]:
            counts[place] -= 1
        fails = False
        for n in {n for n, _ in reads[key]}:
            true = lambda i, n=n: i in known.get(n, ()) or counts[n, i] > 0
            fails = fails or any(holds(a, true) and not holds(b, true) for a, b in rules)
        if fails:
            for place in reads[key]:
                counts[place] += 1
        else:
            gone.append(key[1])
    return gone


def redundant(added: DataFrame, after: Graph, rules: list[Constraint]) -> DataFrame:
    """The edges of ``added`` (round, constraint, src, label, dst) that go.  Raises NotLocal."""
    changing = {r[0] for r in added.select("label").distinct().collect()}
    formulas = Formulas(rules, changing)
    candidates = cut(added.select(*ORDER).withColumn("e", F.monotonically_increasing_id()), "candidates")
    facts = _facts(after, candidates, formulas)
    unread = candidates.select("e").join(facts.where("e IS NOT NULL"), "e", "left_anti")
    gone = [unread]
    for _ in range(SETTLING_ROUNDS):
        verdicts = cut(_verdicts(facts, formulas), "verdicts")
        left, settled = verdicts.agg(F.count_if(F.expr("open AND NOT needed")), F.count_if(F.expr("needed OR NOT open"))).first()
        if not settled:
            break
        gone.append(verdicts.where("NOT open").select("e"))
        if not left:
            return candidates.join(reduce(DataFrame.unionByName, gone), "e", "left_semi").select("src", "label", "dst")
        kept = facts.join(verdicts, "e", "left").where("e IS NULL OR open")
        facts = cut(kept.select("n", "atom", F.when(~F.coalesce("needed", F.lit(False)), F.col("e")).alias("e")).distinct(), "facts")
    states = _states(facts, len(formulas.atoms))
    alive = cut(states.where(_any(formulas.rules, _most, _least)).select("n"), "alive")
    reads = cut(facts.where("e IS NOT NULL").join(alive, "n", "left_semi"), "reads")
    gone.append(facts.where("e IS NOT NULL").select("e").join(reads, "e", "left_anti").distinct())
    known = facts.where("e IS NULL").groupBy("n").agg(F.collect_set("atom").alias("known"))  # no more than the rules have atoms
    rows = reads.join(_groups(reads.select("e", "n").distinct()), "e").join(candidates, "e").join(known, "n", "left")
    trees = formulas.rules

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held = {n: set() if k is None else {int(i) for i in k} for n, k in zip(group["n"], group["known"])}
        listed = zip(zip(*(group[c] for c in ORDER)), group["e"], group["n"], group["atom"])
        return pd.DataFrame({"e": pd.Series([int(e) for e in replay(listed, held, trees)], dtype="int64")})

    gone.append(cut(rows.groupBy("c").applyInPandas(run, "e long"), "replayed"))
    return candidates.join(reduce(DataFrame.unionByName, gone), "e", "left_semi").select("src", "label", "dst")

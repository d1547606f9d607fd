"""Expressions to DataFrame plans.

A node expression becomes a one-column DataFrame ``n``; a path is compiled backwards, from the
set that it must lead into.  ``None`` stands for all nodes, so that the last hop of an existential
path needs no join.  Equal subexpressions share one plan for a graph.

A star is the only construct that needs actions.  Where the edges that it follows are few (counted
up to ``SPINE_EDGES``), they are closed on the driver once for a graph and the pairs joined as a
table that Spark broadcasts if it is small enough; otherwise a semi-naive loop runs on the cluster,
with its state cut through the shared folder every round.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph, cut, small_table
from grafwerk.plans import ast
from grafwerk.plans.parser import parse_node, parse_path

#: Edges of a star, and pairs of its closure, that the driver may hold; and pairs that a plan may carry.
SPINE_EDGES, SPINE_PAIRS, LOCAL_PAIRS = 200_000, 2_000_000, 1000


class Compiler:
    def __init__(self, graph: Graph, spine_edges: int = SPINE_EDGES):
        self.graph, self.spine_edges = graph, spine_edges
        self._plans: dict[ast.Expr, DataFrame] = graph.memo.setdefault(("plans", spine_edges), {})

    # -- node expressions

    def evaluate(self, text: str | ast.Node) -> DataFrame:
        return self.node(parse_node(text) if isinstance(text, str) else text)

    def node(self, e: ast.Node) -> DataFrame:
        if e not in self._plans:
            self._plans[e] = self._node(e)
        return self._plans[e]

    def _node(self, e: ast.Node) -> DataFrame:
        if isinstance(e, ast.Top):
            return self.graph.nodes.select(F.col("node").alias("n"))
        if isinstance(e, ast.ValueEq):
            return self.graph.with_value(e.value)
        if isinstance(e, ast.Has):
            found = self.before(e.path, None)
            return self.node(ast.Top()) if found is None else found
        left, right = self.node(e.left), self.node(e.right)
        if isinstance(e, ast.Disj):
            return left.union(right).distinct()
        if isinstance(e.left, ast.Top) or isinstance(e.right, ast.Top):
            return right if isinstance(e.left, ast.Top) else left
        return left.join(right, "n", "left_semi")

    # -- paths: pre-images

    def before(self, path: ast.Path, target: DataFrame | None) -> DataFrame | None:
        if isinstance(path, ast.Eps):
            return target
        if isinstance(path, ast.Down):
            return self.graph.predecessors(path.label, target)
        if isinstance(path, ast.Up):
            return self.graph.successors(path.label, target)
        if isinstance(path, ast.Seq):
            return self.before(path.left, self.before(path.right, target))
        if isinstance(path, ast.Alt):
            left, right = self.before(path.left, target), self.before(path.right, target)
            return None if left is None or right is None else left.union(right).distinct()
        if isinstance(path, ast.Test):
            inner = self.node(path.node)
            return inner if target is None else target.join(inner, "n", "left_semi")
        if isinstance(path, ast.Star):
            return None if target is None else self._star(path.inner, target)
        pairs = self.pairs(path)
        if target is not None:
            pairs = pairs.join(target.select(F.col("n").alias("y")), "y", "left_semi")
        return pairs.select(F.col("x").alias("n")).distinct()

    def _star(self, inner: ast.Path, target: DataFrame) -> DataFrame:
        closed = self._spine(inner)
        if closed is not None:
            reached = closed.join(target.select(F.col("n").alias("y")), "y", "left_semi").select(F.col("x").alias("n"))
            return target.union(reached).distinct()
        seen = frontier = cut(target.distinct(), "star")
        while frontier.limit(1).count():
            step = self.before(inner, frontier)
            frontier = cut((self.node(ast.Top()) if step is None else step).join(seen, "n", "left_anti"), "star")
            seen = seen.union(frontier)
        return seen

    def _spine(self, inner: ast.Path) -> DataFrame | None:
        """All pairs (x, y), x != y, that one or more steps of ``inner`` connect, if these are few."""
        key = ("spine", inner, self.spine_edges)
        memo = self.graph.memo
        if key not in memo:
            rows = self.pairs(inner).limit(self.spine_edges + 1).collect()
            closed = close(rows, SPINE_PAIRS) if len(rows) <= self.spine_edges else None
            found = None if closed is None else small_table(self.graph.spark, closed, "x string, y string")
            # a large local relation would be part of every plan that reads it
            memo[key] = cut(found, "spine") if found is not None and len(closed) > LOCAL_PAIRS else found
        return memo[key]

    # -- paths: whole relations, for intersections

    def pairs(self, path: ast.Path | str) -> DataFrame:
        """Distinct (x, y)."""
        path = parse_path(path) if isinstance(path, str) else path
        if path not in self._plans:
            self._plans[path] = self._pairs(path)
        return self._plans[path]

    def _pairs(self, path: ast.Path) -> DataFrame:
        if isinstance(path, ast.Eps):
            return self.graph.nodes.select(F.col("node").alias("x"), F.col("node").alias("y"))
        if isinstance(path, ast.Down):
            return self.graph.labelled(path.label).select(F.col("src").alias("x"), F.col("dst").alias("y"))
        if isinstance(path, ast.Up):
            return self.graph.labelled(path.label).select(F.col("dst").alias("x"), F.col("src").alias("y"))
        if isinstance(path, ast.Test):
            found = self.node(path.node)
            return found.select(F.col("n").alias("x"), F.col("n").alias("y"))
        if isinstance(path, ast.Star):
            return self._star_pairs(path.inner)
        left, right = self.pairs(path.left), self.pairs(path.right)
        if isinstance(path, ast.Alt):
            return left.union(right).distinct()
        if isinstance(path, ast.Isect):
            return left.join(right, ["x", "y"], "left_semi")
        return left.withColumnRenamed("y", "m").join(right.withColumnRenamed("x", "m"), "m").select("x", "y").distinct()

    def _star_pairs(self, inner: ast.Path) -> DataFrame:
        same = self.pairs(ast.Eps())
        closed = self._spine(inner)
        if closed is not None:
            return same.union(closed)
        hop = self.pairs(inner).withColumnRenamed("y", "m")
        seen = frontier = cut(same, "star-pairs")
        while frontier.limit(1).count():
            step = hop.join(frontier.withColumnRenamed("x", "m"), "m").select("x", "y").distinct()
            frontier = cut(step.join(seen, ["x", "y"], "left_anti"), "star-pairs")
            seen = seen.union(frontier)
        return seen


def close(pairs: list[tuple[str, str]], most: int) -> list[tuple[str, str]] | None:
    """Pairs (x, y), x != y, with a way from x to y; None if there are more than ``most``."""
    after: dict[str, list[str]] = defaultdict(list)
    for x, y in pairs:
        after[x].append(y)
    out: list[tuple[str, str]] = []
    for x in sorted(after):
        seen, todo = {x}, deque([x])
        while todo:
            for y in after.get(todo.popleft(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
                    out.append((x, y))
        if len(out) > most:
            return None
    return out


def evaluate(graph: Graph, text: str | ast.Node) -> DataFrame:
    """The nodes (n) of an expression."""
    return Compiler(graph).evaluate(text)

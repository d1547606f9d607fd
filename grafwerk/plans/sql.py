"""Expressions as ANSI SQL over ``nodes(node, value)`` and ``edges(src, label, dst)``.

For databases whose recursive queries have set semantics (``WITH RECURSIVE ... UNION``).
"""

from __future__ import annotations

from grafwerk.plans import ast
from grafwerk.plans.parser import parse_node


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class SqlPlan:
    """Collects common table expressions while expressions are rendered."""

    def __init__(self) -> None:
        self.tables: list[tuple[str, str]] = []
        self._named: dict[str, str] = {}

    def named(self, sql: str) -> str:
        """The name of a table that holds this query."""
        if sql not in self._named:
            self._named[sql] = f"x{len(self.tables)}"
            self.tables.append((self._named[sql], sql))
        return self._named[sql]

    def node(self, e: ast.Node) -> str:
        """A table with the column n."""
        if isinstance(e, ast.Top):
            return self.named("SELECT node AS n FROM nodes")
        if isinstance(e, ast.ValueEq):
            return self.named(f"SELECT node AS n FROM nodes WHERE value = {quoted(e.value)}")
        if isinstance(e, ast.Has):
            return self.before(e.path, None)
        word = "INTERSECT" if isinstance(e, ast.Conj) else "UNION"
        return self.named(f"SELECT n FROM {self.node(e.left)} {word} SELECT n FROM {self.node(e.right)}")

    def before(self, path: ast.Path, target: str | None) -> str:
        """Nodes from which the path leads into ``target`` (any node if None)."""
        if isinstance(path, ast.Seq):
            return self.before(path.left, self.before(path.right, target))
        if isinstance(path, ast.Alt):
            return self.named(f"SELECT n FROM {self.before(path.left, target)} UNION SELECT n FROM {self.before(path.right, target)}")
        if isinstance(path, (ast.Down, ast.Up)):
            x, y = ("src", "dst") if isinstance(path, ast.Down) else ("dst", "src")
            goal = f" AND {y} IN (SELECT n FROM {target})" if target else ""
            return self.named(f"SELECT DISTINCT {x} AS n FROM edges WHERE label = {quoted(path.label)}{goal}")
        target = target or self.node(ast.Top())
        if isinstance(path, ast.Eps):
            return target
        if isinstance(path, ast.Test):
            return self.named(f"SELECT n FROM {target} INTERSECT SELECT n FROM {self.node(path.node)}")
        if isinstance(path, ast.Star):
            hop, name = self.pairs(path.inner), f"x{len(self.tables)}"
            self.tables.append((name, f"SELECT n FROM {target} UNION SELECT h.x FROM {hop} h JOIN {name} s ON h.y = s.n"))
            return name
        return self.named(f"SELECT DISTINCT x AS n FROM {self.pairs(path)} WHERE y IN (SELECT n FROM {target})")

    def pairs(self, path: ast.Path) -> str:
        """A table with the columns x, y of the whole relation."""
        if isinstance(path, ast.Eps):
            return self.named("SELECT node AS x, node AS y FROM nodes")
        if isinstance(path, ast.Down):
            return self.named(f"SELECT src AS x, dst AS y FROM edges WHERE label = {quoted(path.label)}")
        if isinstance(path, ast.Up):
            return self.named(f"SELECT dst AS x, src AS y FROM edges WHERE label = {quoted(path.label)}")
        if isinstance(path, ast.Test):
            return self.named(f"SELECT n AS x, n AS y FROM {self.node(path.node)}")
        if isinstance(path, ast.Seq):
            return self.named(f"SELECT DISTINCT a.x, b.y FROM {self.pairs(path.left)} a JOIN {self.pairs(path.right)} b ON a.y = b.x")
        if isinstance(path, (ast.Alt, ast.Isect)):
            word = "UNION" if isinstance(path, ast.Alt) else "INTERSECT"
            return self.named(f"SELECT x, y FROM {self.pairs(path.left)} {word} SELECT x, y FROM {self.pairs(path.right)}")
        hop, name = self.pairs(path.inner), f"x{len(self.tables)}"
        self.tables.append((name, f"SELECT node AS x, node AS y FROM nodes UNION SELECT h.x, s.y FROM {hop} h JOIN {name} s ON h.y = s.x"))
        return name

    def with_clause(self, *first: tuple[str, str]) -> str:
        return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({sql})" for name, sql in (*first, *self.tables))


def node_query(text: str, first: tuple[tuple[str, str], ...]) -> str:
    """A query for the nodes of an expression; ``first`` defines nodes and edges."""
    plan = SqlPlan()
    table = plan.node(parse_node(text))
    return f"{plan.with_clause(*first)}\nSELECT n FROM {table}"

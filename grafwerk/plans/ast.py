"""Expressions over a labelled graph: paths (binary relations) and nodes (sets)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Expr:
    """Base of both sorts; expressions are immutable and can be used as keys."""

    def parts(self) -> tuple["Expr", ...]:
        return tuple(v for v in vars(self).values() if isinstance(v, Expr))

    def walk(self) -> Iterator["Expr"]:
        yield self
        for part in self.parts():
            yield from part.walk()


class Path(Expr):
    pass


class Node(Expr):
    pass


@dataclass(frozen=True)
class Eps(Path):
    def __str__(self) -> str:
        return "eps"


@dataclass(frozen=True)
class Down(Path):
    label: str

    def __str__(self) -> str:
        return f"down({self.label})"


@dataclass(frozen=True)
class Up(Path):
    label: str

    def __str__(self) -> str:
        return f"up({self.label})"


@dataclass(frozen=True)
class Seq(Path):
    left: Path
    right: Path

    def __str__(self) -> str:
        return " . ".join(f"({p})" if isinstance(p, Seq) and p is self.right else str(p) for p in (self.left, self.right))


@dataclass(frozen=True)
class Alt(Path):
    left: Path
    right: Path

    def __str__(self) -> str:
        return " + ".join(f"({p})" if isinstance(p, Seq) or (isinstance(p, Alt) and p is self.right) else str(p) for p in (self.left, self.right))


@dataclass(frozen=True)
class Star(Path):
    inner: Path

    def __str__(self) -> str:
        return f"({self.inner})*" if isinstance(self.inner, (Seq, Alt)) else f"{self.inner}*"


@dataclass(frozen=True)
class Isect(Path):
    left: Path
    right: Path

    def __str__(self) -> str:
        return f"isect({self.left}, {self.right})"


@dataclass(frozen=True)
class Test(Path):
    node: "Node"

    __test__ = False

    def __str__(self) -> str:
        return f"[{self.node}]"


@dataclass(frozen=True)
class Top(Node):
    def __str__(self) -> str:
        return "T"


@dataclass(frozen=True)
class ValueEq(Node):
    value: str

    def __str__(self) -> str:
        return f'val("{self.value}")'


@dataclass(frozen=True)
class Has(Node):
    path: Path

    def __str__(self) -> str:
        return f"< {self.path} >"


@dataclass(frozen=True)
class Conj(Node):
    left: Node
    right: Node

    def __str__(self) -> str:
        return " & ".join(f"({p})" if isinstance(p, Disj) or (isinstance(p, Conj) and p is self.right) else str(p) for p in (self.left, self.right))


@dataclass(frozen=True)
class Disj(Node):
    left: Node
    right: Node

    def __str__(self) -> str:
        return " | ".join(f"({p})" if isinstance(p, Disj) and p is self.right else str(p) for p in (self.left, self.right))


def sequence(*paths: Path) -> Path:
    """All paths one after the other; eps for none."""
    found: Path | None = None
    for path in paths:
        found = path if found is None else Seq(found, path)
    return found or Eps()


def type_test(type_label: str, subclass_label: str, value: str) -> Has:
    """Nodes with a type that is, or lies below, the class of this value."""
    return Has(sequence(Down(type_label), Star(Down(subclass_label)), Test(ValueEq(value))))


def has_edge(label: str) -> Has:
    return Has(Down(label))


def is_target_of(label: str) -> Has:
    return Has(Up(label))


def labels(expr: Expr) -> set[str]:
    return {e.label for e in expr.walk() if isinstance(e, (Down, Up))}


def constants(expr: Expr) -> set[str]:
    return {e.value for e in expr.walk() if isinstance(e, ValueEq)}


def flatten(path: Path) -> list[Path]:
    """The steps of a path of sequences."""
    return [*flatten(path.left), *flatten(path.right)] if isinstance(path, Seq) else [path]

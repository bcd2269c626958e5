"""Query algebra: plain dataclasses, one per operation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from quadloom.model import BNODE, IRI, LITERAL, STRING


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    kind: int
    value: str
    dt: str = ""
    lang: str = ""


def named(value: str) -> Term:
    return Term(IRI, value)


def text(value: str, dt: str = STRING, lang: str = "") -> Term:
    return Term(LITERAL, value, dt, lang)


def blank(label: str) -> Term:
    return Term(BNODE, label)


Node = Var | Term


class Op:
    """Any operation."""


@dataclass(frozen=True)
class Pattern(Op):
    s: Node
    p: Node
    o: Node

    def variables(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in (self.s, self.p, self.o) if isinstance(x, Var)))


@dataclass(frozen=True)
class Path(Op):
    """kind: link, inverse, seq, alt, opt, plus, star or not; not takes links and inverse links."""

    kind: str
    parts: tuple = ()
    iri: str = ""


@dataclass(frozen=True)
class PathPattern(Op):
    s: Node
    path: Path
    o: Node


@dataclass
class Join(Op):
    parts: list[Op]


@dataclass
class Given(Op):
    """Solutions that are known already; holder is a joins.Solutions."""

    holder: object


@dataclass
class LeftJoin(Op):
    left: Op
    right: Op
    condition: Expr | None = None


@dataclass
class Minus(Op):
    left: Op
    right: Op


@dataclass
class Union(Op):
    parts: list[Op]


@dataclass
class Filter(Op):
    child: Op
    condition: Expr


@dataclass
class Extend(Op):
    child: Op
    name: str
    value: Expr


@dataclass
class Values(Op):
    names: list[str]
    rows: list[list[Term | None]]


@dataclass
class Graph(Op):
    graph: Node
    child: Op


@dataclass
class Service(Op):
    endpoint: Node
    child: Op
    silent: bool = False


@dataclass
class Group(Op):
    child: Op
    keys: list[tuple[str, Expr]]
    aggregates: list[tuple[str, Aggregate]]


@dataclass
class Project(Op):
    child: Op
    names: list[str]


@dataclass
class Distinct(Op):
    child: Op


@dataclass
class Reduced(Op):
    child: Op


@dataclass
class OrderBy(Op):
    child: Op
    keys: list[tuple[Expr, bool]]


@dataclass
class Slice(Op):
    child: Op
    offset: int = 0
    limit: int | None = None


@dataclass
class From(Op):
    child: Op
    default: list[str]
    named: list[str]


@dataclass
class Ask(Op):
    child: Op


@dataclass
class Construct(Op):
    child: Op
    template: list[Pattern]


@dataclass
class Describe(Op):
    child: Op | None
    terms: list[Node]


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Value(Expr):
    node: Node


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple = ()


@dataclass
class Exists(Expr):
    child: Op
    negated: bool = False


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str
    arg: Expr | None = None
    distinct: bool = False
    separator: str = " "


@dataclass
class Update:
    """kind: insert, delete, modify, load, clear, create, drop, copy, move or add."""

    kind: str
    delete: list = field(default_factory=list)
    insert: list = field(default_factory=list)
    where: Op | None = None
    source: str | None = None
    target: str | None = None
    silent: bool = False


def walk(op) -> Iterator:
    """The operation and all below it, expressions included."""
    if isinstance(op, Op | Expr):
        yield op
        for f in fields(op):
            yield from walk(getattr(op, f.name))
    elif isinstance(op, list | tuple):
        for x in op:
            yield from walk(x)


def replaced(op, old: Op, new: Op):
    """op with the operation ``old`` (that very object) replaced by ``new``."""
    if op is old:
        return new
    if isinstance(op, Op | Expr) and not isinstance(op, Given):
        return type(op)(*[replaced(getattr(op, f.name), old, new) for f in fields(op)])
    if isinstance(op, list | tuple):
        return type(op)(replaced(x, old, new) for x in op)
    return op


def patterns(op: Op) -> list[Pattern]:
    """Every triple pattern of a query; property paths hold none."""
    return [x for x in walk(op) if isinstance(x, Pattern)]

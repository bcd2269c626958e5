"""SPARQL endpoints as sources: whole groups are pushed down as text, with the bindings known so far.

``write`` says an operation in SPARQL. An ``Endpoint`` among an engine's services answers SERVICE:
its group is one request, or, joined to few enough bindings of what it shares with the rest of
the query, one request for each block of them (a bind join). Requests run in Spark tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import BNODE, IRI, LANG_STRING, LITERAL, STRING, TERM
from quadloom.operators.joins import Solutions
from quadloom.plans import algebra as A

#: Bindings sent with one request, and at most in all; beyond, the group is asked without any.
BLOCK, MOST_BINDINGS = 50, 5000
_INFIX = {"||", "&&", "=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/"}
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


class NotWritable(NotImplementedError):
    """An operation that has no text here."""


def node(x: A.Node) -> str:
    if isinstance(x, A.Var):
        return f"?{x.name}"
    if x.kind == IRI:
        return f"<{x.value}>"
    if x.kind == BNODE:
        return f"_:{x.value}"
    quoted = '"' + "".join(_ESCAPES.get(c, c) for c in x.value) + '"'
    return f"{quoted}@{x.lang}" if x.lang else quoted if x.dt in ("", STRING) else f"{quoted}^^<{x.dt}>"


def path(p: A.Path) -> str:
    inner = [path(x) for x in p.parts]
    if p.kind == "link":
        return f"<{p.iri}>"
    if p.kind == "inverse":
        return f"^({inner[0]})" if p.parts[0].kind != "link" else f"^{inner[0]}"
    if p.kind in ("seq", "alt"):
        return "(" + {"seq": "/", "alt": "|"}[p.kind].join(inner) + ")"
    if p.kind == "not":
        return "!(" + "|".join(inner) + ")"
    return f"({inner[0]})" + {"opt": "?", "plus": "+", "star": "*"}[p.kind]


def expression(e: A.Expr) -> str:
    if isinstance(e, A.Value):
        return node(e.node)
    if isinstance(e, A.Exists):
        return ("NOT " if e.negated else "") + "EXISTS { " + write(e.child) + " }"
    if isinstance(e, A.Call):
        args = [expression(a) for a in e.args]
        if e.name in _INFIX and len(args) == 2:
            return f"({args[0]} {e.name} {args[1]})"
        if e.name in ("U!", "U-"):
            return f"({e.name[1]} {args[0]})"
        if e.name in ("IN", "NOT IN"):
            return f"({args[0]} {e.name} ({', '.join(args[1:])}))"
        return (f"<{e.name}>" if ":" in e.name else e.name) + "(" + ", ".join(args) + ")"
    raise NotWritable(type(e).__name__)


def write(op: A.Op) -> str:
    """The inside of a group."""
    if isinstance(op, A.Pattern):
        return f"{node(op.s)} {node(op.p)} {node(op.o)} ."
    if isinstance(op, A.PathPattern):
        return f"{node(op.s)} {path(op.path)} {node(op.o)} ."
    if isinstance(op, A.Join):
        return " ".join(write(p) if isinstance(p, A.Pattern | A.PathPattern) else "{ " + write(p) + " }" for p in op.parts)
    if isinstance(op, A.LeftJoin):
        condition = f" FILTER({expression(op.condition)})" if op.condition is not None else ""
        return f"{{ {write(op.left)} }} OPTIONAL {{ {write(op.right)}{condition} }}"
    if isinstance(op, A.Minus):
        return f"{{ {write(op.left)} }} MINUS {{ {write(op.right)} }}"
    if isinstance(op, A.Union):
        return " UNION ".join(f"{{ {write(p)} }}" for p in op.parts)
    if isinstance(op, A.Filter):
        return f"{write(op.child)} FILTER({expression(op.condition)})"
    if isinstance(op, A.Extend):
        return f"{write(op.child)} BIND({expression(op.value)} AS ?{op.name})"
    if isinstance(op, A.Graph):
        return f"GRAPH {node(op.graph)} {{ {write(op.child)} }}"
    if isinstance(op, A.Values):
        rows = " ".join("(" + " ".join("UNDEF" if t is None else node(t) for t in row) + ")" for row in op.rows)
        return f"VALUES ({' '.join('?' + n for n in op.names)}) {{ {rows} }}"
    raise NotWritable(type(op).__name__)


def bound(op: A.Op) -> dict[str, bool]:
    """Variables that a group gives, and whether a solution may leave them unbound."""
    if isinstance(op, A.Pattern | A.PathPattern):
        return {x.name: False for x in (op.s, getattr(op, "p", None), op.o) if isinstance(x, A.Var)}
    if isinstance(op, A.Join):
        out: dict[str, bool] = {}
        for p in op.parts:
            out = {v: maybe and out.get(v, True) for v, maybe in bound(p).items()} | {v: m for v, m in out.items() if v not in bound(p)}
        return out
    if isinstance(op, A.LeftJoin):
        left = bound(op.left)
        return dict.fromkeys(bound(op.right), True) | left
    if isinstance(op, A.Union):
        parts = [bound(p) for p in op.parts]
        return {v: any(p.get(v, True) for p in parts) for p in parts for v in p}
    if isinstance(op, A.Extend):
        return bound(op.child) | {op.name: True}
    if isinstance(op, A.Values):
        return {n: any(row[i] is None for row in op.rows) for i, n in enumerate(op.names)}
    if isinstance(op, A.Graph):
        return ({op.graph.name: False} if isinstance(op.graph, A.Var) else {}) | bound(op.child)
    if isinstance(op, A.Filter | A.Minus):
        return bound(op.child if isinstance(op, A.Filter) else op.left)
    raise NotWritable(type(op).__name__)


def post(url: str, query: str) -> str:
    """A query sent by the protocol; JSON results."""
    request = Request(url, data=query.encode(), headers={"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json"})
    with urlopen(request, timeout=300) as reply:
        return reply.read().decode()


def term_of(x: dict | None) -> tuple | None:
    """A term of JSON results."""
    if x is None:
        return None
    if x["type"] == "uri":
        return IRI, x["value"], "", ""
    if x["type"] == "bnode":
        return BNODE, x["value"], "", ""
    lang = x.get("xml:lang", "").lower()
    return LITERAL, x["value"], LANG_STRING if lang else x.get("datatype", STRING), lang


@dataclass
class Endpoint:
    """fetch(url, query) gives JSON results; it runs in tasks, which Spark repeats where it fails."""

    url: str
    fetch: Callable[[str, str], str] = post

    def solutions(self, spark: SparkSession, op: A.Op, given: Solutions | None = None) -> Solutions:
        variables = bound(op)
        body = write(op)
        keys = [v for v in variables if given is not None and given.variables.get(v) is False]
        requests = None
        if keys:
            # Blank nodes of one source mean nothing to another.
            known = given.df.select(*[F.col(f"`{v}`") for v in keys]).distinct().filter(" and ".join(f"`{v}`.kind <> {BNODE}" for v in keys))
            few = known.limit(MOST_BINDINGS + 1).collect()  # a checked bound
            if len(few) <= MOST_BINDINGS:
                rows = [[A.Term(*r[v]) for v in keys] for r in few]
                requests = [f"SELECT * {{ {write(A.Values(keys, rows[i : i + BLOCK]))} {body} }}" for i in range(0, len(rows), BLOCK)]
        if requests is None:
            requests = [f"SELECT * {{ {body} }}"]
        url, fetch, names = self.url, self.fetch, list(variables)

        def ask(frames):
            for frame in frames:
                for query in frame["query"]:
                    found = json.loads(fetch(url, query))["results"]["bindings"]
                    if found:
                        yield pd.DataFrame({f"c{i}": [dict(zip(("kind", "value", "dt", "lang"), t, strict=True)) if (t := term_of(row.get(n))) else None for row in found] for i, n in enumerate(names)})

        asked: DataFrame = spark.createDataFrame([(q,) for q in requests], "query string").repartition(max(1, min(len(requests), 16)))
        made = asked.mapInPandas(ask, ", ".join(f"c{i} {TERM}" for i in range(len(names))))
        return Solutions(made.toDF(*names), variables)

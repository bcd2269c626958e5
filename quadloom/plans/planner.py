"""Algebra to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.aggregate import AGGREGATES
from quadloom.functions.scalar import FUNCTIONS, V, call, ebv, of_integer, order_key
from quadloom.model import BNODE, BOOLEAN, IRI, LITERAL, TERM, term
from quadloom.operators import joins, paths
from quadloom.operators.cardinality import Statistics
from quadloom.operators.joins import Solutions
from quadloom.plans import algebra as A
from quadloom.plans import ordering
from quadloom.sources.tables import Tables


@dataclass
class Context:
    """Options of one query.

    link_filters is shared and grows during traversal; it always exists. distinct_graphs: no triple
    is in two graphs, so the union of all graphs needs no distinct. tables answers stars over
    tables by one scan.
    """

    spark: SparkSession
    quads: DataFrame | Tables
    distinct_graphs: bool = True
    tables: Tables | None = None
    statistics: list[Statistics] = field(default_factory=list)
    join_order: str = "cardinality"
    services: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    graph: A.Node | None = None
    default_graphs: list[str] | None = None
    named_graphs: list[str] | None = None
    link_filters: list = field(default_factory=list)


#: What makes two quads of different graphs the same triple.
TRIPLE = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]


def constant(node: A.Term) -> Column:
    return term(node.kind, F.lit(node.value), node.dt, node.lang)


def _position(name: str) -> Column:
    """A position of a quad, which is never unbound: a plain struct, so that Catalyst drops what nobody reads."""
    kind, dt, lang = ("s_kind", None, None) if name == "s" else ("o_kind", "o_dt", "o_lang") if name == "o" else (None, None, None)
    return F.struct(
        (F.col(kind) if kind else F.lit(IRI).cast("tinyint")).alias("kind"), F.col(name).alias("value"),
        (F.col(dt) if dt else F.lit("")).alias("dt"), (F.col(lang) if lang else F.lit("")).alias("lang"),
    )


class Planner:
    def __init__(self, context: Context) -> None:
        self.c = context

    def within(self, **changes) -> Planner:
        return Planner(replace(self.c, **changes))

    def unit(self) -> Solutions:
        return Solutions(self.c.spark.range(1), {})

    # Scans
    def scope(self) -> DataFrame:
        """Quads of the active graph."""
        quads, graph = self.c.quads, self.c.graph
        if isinstance(quads, Tables):
            quads = quads.quads
        if isinstance(graph, A.Term):
            return quads.filter(F.col("g") == graph.value) if self.c.named_graphs is None or graph.value in self.c.named_graphs else quads.limit(0)
        if graph is not None:
            return quads.filter(F.col("g").isin(*self.c.named_graphs)) if self.c.named_graphs is not None else quads.filter("g <> ''")
        if self.c.default_graphs is not None:
            quads = quads.filter(F.col("g").isin(*self.c.default_graphs))
            return quads.dropDuplicates(TRIPLE) if len(self.c.default_graphs) > 1 and not self.c.distinct_graphs else quads
        return quads if self.c.distinct_graphs else quads.dropDuplicates(TRIPLE)

    def pattern(self, op: A.Pattern) -> Solutions:
        df = self.scope()
        where: dict[str, list[str]] = {}
        for name, node in (("s", op.s), ("p", op.p), ("o", op.o)):
            if isinstance(node, A.Var):
                where.setdefault(node.name, []).append(name)
                continue
            df = df.filter(F.col(name) == node.value)
            if name != "p":
                df = df.filter(F.col(f"{name}_kind") == node.kind)
            if name == "o" and node.kind == LITERAL:
                df = df.filter((F.col("o_dt") == node.dt) & (F.col("o_lang") == node.lang))
        if isinstance(self.c.graph, A.Var):
            where.setdefault(self.c.graph.name, []).append("g")
        for names in where.values():
            for other in names[1:]:
                df = df.filter(_position(names[0]) == _position(other))
        return Solutions(df.select(*[_position(names[0]).alias(v) for v, names in where.items()]) if where else df.select(F.lit(1).alias("__one")), dict.fromkeys(where, False))

    def path(self, op: A.PathPattern) -> Solutions:
        start = None
        if isinstance(op.s, A.Term):
            start = self.c.spark.range(1).select(constant(op.s).alias("s"))
        path, s, o = op.path, op.s, op.o
        if start is None and isinstance(op.o, A.Term) and path.kind in ("plus", "star", "opt"):
            # Walk backwards from a constant object.
            path, s, o = A.Path(path.kind, (A.Path("inverse", path.parts),)), op.o, op.s
            start = self.c.spark.range(1).select(constant(op.o).alias("s"))
        df = paths.pairs(self.scope(), path, start)
        names: dict[str, str] = {}
        for column, node in (("s", s), ("o", o)):
            if isinstance(node, A.Term):
                df = df.filter(F.col(column) == constant(node))
            elif node.name in names:
                df = df.filter(F.col("s") == F.col("o"))
            else:
                names[node.name] = column
        return Solutions(df.select(*[F.col(c).alias(v) for v, c in names.items()]) if names else df.select(F.lit(1).alias("__one")), dict.fromkeys(names, False))

    # Operators
    def run(self, op: A.Op) -> Solutions:
        return getattr(self, "_" + type(op).__name__.lower())(op)

    def _pattern(self, op: A.Pattern) -> Solutions:
        found = self.stars([op])[0]
        return found if isinstance(found, Solutions) else self.pattern(op)

    def _pathpattern(self, op: A.PathPattern) -> Solutions:
        return self.path(op)

    def _join(self, op: A.Join) -> Solutions:
        if not op.parts:
            return self.unit()
        parts = op.parts
        if len(parts) > 2 or self.c.statistics:
            sizes = ordering.estimates(parts, self.c.statistics)
            if self.c.join_order == "zero-knowledge":
                order = ordering.zero_knowledge(parts)
            elif self.c.join_order == "selectivity" and self.c.statistics:
                order = ordering.by_selectivity(parts, sizes, self.c.statistics[0])
            else:
                order = ordering.smallest_connected(parts, sizes)
            parts = [parts[i] for i in order]
        now: Solutions | None = None
        for part in self.stars(parts):
            source = self.c.services.get(part.endpoint.value) if isinstance(part, A.Service) and isinstance(part.endpoint, A.Term) else None
            if now is not None and hasattr(source, "solutions") and not part.silent:
                # An endpoint is told the bindings that its group must join with.
                part = source.solutions(self.c.spark, part.child, now)
            more = self.run(part) if isinstance(part, A.Op) else part
            now = more if now is None else joins.join(now, more)
        return now

    def stars(self, parts: list[A.Op]) -> list[A.Op | Solutions]:
        """Patterns on one subject whose columns one table holds, as one scan in the place of the first of them."""
        if self.c.tables is None or self.c.graph is not None or self.c.default_graphs is not None:
            return parts
        groups: dict[tuple, list[int]] = {}
        for i, p in enumerate(parts):
            if isinstance(p, A.Pattern) and isinstance(p.s, A.Var) and isinstance(p.p, A.Term) and (table := self.c.tables.table_of(p.p.value)):
                groups.setdefault((p.s, table), []).append(i)
        out: dict[int, A.Op | Solutions] = dict(enumerate(parts))
        for (subject, table), members in groups.items():
            objects = [parts[i].o for i in members if isinstance(parts[i].o, A.Var)]
            # A variable that stands twice asks for an equality between cells: left to the join.
            if len({subject, *objects}) == 1 + len(objects):
                out[members[0]] = self.c.tables.star(table, subject.name, [(parts[i].p.value, parts[i].o) for i in members])
                for i in members[1:]:
                    del out[i]
        return list(out.values())

    def _given(self, op: A.Given) -> Solutions:
        return op.holder

    def _leftjoin(self, op: A.LeftJoin) -> Solutions:
        condition = (lambda sight: ebv(self.expression(op.condition, sight))) if op.condition is not None else None
        return joins.optional(self.run(op.left), self.run(op.right), condition)

    def _minus(self, op: A.Minus) -> Solutions:
        return joins.minus(self.run(op.left), self.run(op.right))

    def _union(self, op: A.Union) -> Solutions:
        return joins.union([self.run(p) for p in op.parts])

    def _exists(self, now: Solutions, part: A.Exists, negated: bool) -> Solutions:
        inner, condition = part.child, None
        if isinstance(inner, A.Filter) and not any(isinstance(x, A.Exists) for x in A.walk(inner.condition)):
            # A filter inside EXISTS sees the outer row.
            inner, condition = inner.child, lambda sight, e=inner.condition: ebv(self.expression(e, sight))
        return joins.exists(now, self.run(inner), negated, condition)

    def _filter(self, op: A.Filter) -> Solutions:
        now = self.run(op.child)
        for part in _conjuncts(op.condition):
            if isinstance(part, A.Exists):
                now = self._exists(now, part, part.negated)
            else:
                marked, part = self._mark_exists(now, part)
                now = now.with_df(marked.df.filter(ebv(self.expression(part, _sight(marked)))))
        return now

    def _mark_exists(self, now: Solutions, e: A.Expr) -> tuple[Solutions, A.Expr]:
        """Each EXISTS inside an expression becomes a variable: a boolean literal on the rows that have a match and those that have none."""
        if isinstance(e, A.Exists):
            name = f"__exists{len(now.variables)}"
            now = now.plain()
            made = [self._exists(now, e, none).df.select("*", constant(A.text("false" if none != e.negated else "true", BOOLEAN)).alias(name)) for none in (False, True)]
            return Solutions(made[0].unionByName(made[1]), now.variables | {name: False}), A.Value(A.Var(name))
        if isinstance(e, A.Call):
            args = []
            for a in e.args:
                now, a = self._mark_exists(now, a)
                args.append(a)
            return now, A.Call(e.name, tuple(args))
        return now, e

    def _extend(self, op: A.Extend) -> Solutions:
        now = self.run(op.child)
        marked, value = self._mark_exists(now, op.value)
        return Solutions(marked.df.withColumn(op.name, self.expression(value, _sight(marked)).term()), now.variables | {op.name: True})

    def _values(self, op: A.Values) -> Solutions:
        plain = ", ".join(f"c{i} {TERM}" for i in range(len(op.names))) or "one int"
        rows = [tuple(None if t is None else (t.kind, t.value, t.dt, t.lang) for t in row) or (1,) for row in op.rows]
        df = self.c.spark.createDataFrame(rows, plain)
        return Solutions(df.toDF(*op.names) if op.names else df, {n: any(row[i] is None for row in op.rows) for i, n in enumerate(op.names)})

    def _graph(self, op: A.Graph) -> Solutions:
        return self.within(graph=op.graph).run(op.child)

    def _service(self, op: A.Service) -> Solutions:
        if isinstance(op.endpoint, A.Var):
            # Every endpoint this engine knows, with its name bound.
            found = [self._service(A.Service(A.named(name), op.child, op.silent)) for name in self.c.services]
            values = [A.Values([op.endpoint.name], [[A.named(name)]]) for name in self.c.services]
            if not found:
                return self._values(A.Values([op.endpoint.name], []))
            return joins.union([joins.join(x, self._values(v)) for x, v in zip(found, values, strict=True)])
        try:
            source = self.c.services[op.endpoint.value]
            if hasattr(source, "solutions"):
                return source.solutions(self.c.spark, op.child)
            quads = source()
        except Exception:
            if op.silent:
                return self.unit()
            raise
        return self.within(quads=quads, tables=None, distinct_graphs=False, statistics=[], graph=None, default_graphs=None, named_graphs=None).run(op.child)

    def _from(self, op: A.From) -> Solutions:
        return self.within(default_graphs=op.default, named_graphs=op.named).run(op.child)

    def _group(self, op: A.Group) -> Solutions:
        now = self.run(op.child)
        sight = _sight(now)
        keys = [self.expression(e, sight).term().alias(name) for name, e in op.keys]
        made = []
        for name, a in op.aggregates:
            if a.arg is None:
                if a.distinct:
                    whole = F.struct(*[F.coalesce(F.to_json(F.col(f"`{v}`")), F.lit("")) for v in now.variables] or [F.lit(1)])
                    made.append(of_integer(F.count_distinct(whole)).term().alias(name))
                else:
                    made.append(of_integer(F.count(F.lit(1))).term().alias(name))
            else:
                made.append(AGGREGATES[a.name](self.expression(a.arg, sight), a.distinct, a.separator).alias(name))
        df = now.df.groupBy(*keys).agg(*made) if made else now.df.select(*keys).distinct()
        key_maybe = {name: not (isinstance(e, A.Value) and isinstance(e.node, A.Var) and not now.variables.get(e.node.name, True)) for name, e in op.keys}
        return Solutions(df, key_maybe | {name: a.name != "COUNT" for name, a in op.aggregates})

    def _project(self, op: A.Project) -> Solutions:
        now = self.run(op.child)
        if op.names == ["*"]:
            # Variables that stand for blank nodes and the like are nobody's business.
            return Solutions(now.df, {v: maybe for v, maybe in now.variables.items() if not v.startswith("__")})
        df = now.df.select(*[F.col(f"`{v}`") if v in now.variables else F.lit(None).cast(TERM).alias(v) for v in op.names])
        return Solutions(df, {v: now.variables.get(v, True) for v in op.names})

    def _distinct(self, op: A.Distinct) -> Solutions:
        now = self.run(op.child)
        now = now.plain()
        return now.with_df(now.df.distinct())

    def _reduced(self, op: A.Reduced) -> Solutions:
        return self.run(op.child)

    def _orderby(self, op: A.OrderBy) -> Solutions:
        now = self.run(op.child)
        keys = [order_key(self.expression(e, _sight(now))) for e, _ in op.keys]
        return now.with_df(now.df.orderBy(*[k.asc() if up else k.desc() for k, (_, up) in zip(keys, op.keys, strict=True)]))

    def _slice(self, op: A.Slice) -> Solutions:
        now = self.run(op.child)
        df = now.df.offset(op.offset) if op.offset else now.df
        return now.with_df(df if op.limit is None else df.limit(op.limit))

    # Expressions
    def expression(self, e: A.Expr, sight: dict[str, Column]) -> V:
        if isinstance(e, A.Value):
            if isinstance(e.node, A.Term):
                return V.constant(e.node.kind, e.node.value, e.node.dt, e.node.lang)
            return V.of(sight.get(e.node.name, F.lit(None).cast(TERM)))
        if isinstance(e, A.Call):
            if e.name not in FUNCTIONS:
                raise ValueError(f"unknown function {e.name}")
            return call(e.name, [self.expression(a, sight) for a in e.args])
        raise NotImplementedError(f"{type(e).__name__} in this place")

    # Query forms
    def ask(self, op: A.Op) -> bool:
        return not self.run(op).df.limit(1).isEmpty()

    def construct(self, op: A.Construct) -> DataFrame:
        """Distinct triples of the template; rows with unbound or ill-placed terms give none."""
        now = self.run(op.child)
        return instantiate(now, [(None, p) for p in op.template], A.named("")).drop("g").distinct()

    def describe(self, op: A.Describe) -> DataFrame:
        """Triples of each resource, and of the blank nodes they lead to."""
        parts = [self.c.spark.range(1).select(constant(t).alias("s")) for t in op.terms if isinstance(t, A.Term)]
        names = [t.name for t in op.terms if isinstance(t, A.Var)]
        if op.child is not None:
            now = self.run(op.child)
            parts += [now.df.select(F.col(f"`{v}`").alias("s")) for v in names or now.variables]
        found = reduce(DataFrame.unionByName, parts).filter("s is not null").distinct()
        quads = self.scope()
        subject = F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("value"))
        wanted = found.select(F.struct(F.col("s.kind").alias("kind"), F.col("s.value").alias("value")).alias("__s"))
        columns = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
        out = quads.join(wanted, subject == F.col("__s"), "left_semi").select(*columns)
        frontier = out
        while not (blank := frontier.filter(F.col("o_kind") == BNODE).select(F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("value")).alias("__s")).distinct()).isEmpty():
            frontier = paths.cut(quads.join(blank, subject == F.col("__s"), "left_semi").select(*columns).exceptAll(out.select(*columns)))
            if frontier.isEmpty():
                break
            out = out.unionByName(frontier)
        return out.distinct()


def _sight(now: Solutions) -> dict[str, Column]:
    return {v: F.col(f"`{v}`") for v in now.variables}


def _conjuncts(e: A.Expr) -> list[A.Expr]:
    if isinstance(e, A.Call) and e.name == "&&":
        return [x for a in e.args for x in _conjuncts(a)]
    return [e]


def instantiate(now: Solutions, template: list[tuple[A.Node | None, A.Pattern]], default_graph: A.Term) -> DataFrame:
    """Quads of a template over solutions; blank nodes of the template are new for each row."""
    rows = now.df.withColumn("__row", F.monotonically_increasing_id()) if any(isinstance(n, A.Term) and n.kind == BNODE for _, p in template for n in (p.s, p.o)) else now.df

    def node(x: A.Node) -> Column:
        if isinstance(x, A.Var):
            return F.col(f"`{x.name}`") if x.name in now.variables else F.lit(None).cast(TERM)
        return term(BNODE, F.concat(F.lit(x.value + "_"), F.col("__row").cast("string"))) if x.kind == BNODE else constant(x)

    quads = F.array(*[F.struct(node(g or default_graph).alias("g"), node(p.s).alias("s"), node(p.p).alias("p"), node(p.o).alias("o")) for g, p in template])
    made = rows.select(F.explode(quads).alias("q")).filter("q.g is not null and q.s is not null and q.p is not null and q.o is not null").filter((F.col("q.s.kind") != LITERAL) & (F.col("q.p.kind") == IRI))
    return made.select(F.col("q.g.value").alias("g"), F.col("q.s.kind").alias("s_kind"), F.col("q.s.value").alias("s"), F.col("q.p.value").alias("p"), F.col("q.o.kind").alias("o_kind"), F.col("q.o.value").alias("o"), F.col("q.o.dt").alias("o_dt"), F.col("q.o.lang").alias("o_lang"))

"""Queries by link traversal: documents are dereferenced round by round, starting from seeds.

Each round reads the documents of the frontier, learns deny rules and dataset descriptions from
them, extracts and filters links, and re-estimates the query's patterns from what has been read:
the statistics of the round join those known (``cardinality.accumulate``). The query's topmost
join runs while documents arrive, as an adaptive join over the rounds that follows these
estimates; the rest of the query is evaluated over all documents visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.model import BNODE, MEM, VOID
from quadloom.operators import joins, linkfilters, traversal
from quadloom.operators.adaptive import AdaptiveJoin, RestartConfig, gate
from quadloom.operators.cardinality import Statistics, accumulate, describe, selectivity
from quadloom.operators.joins import Solutions
from quadloom.plans import algebra as A
from quadloom.plans import ordering
from quadloom.plans.parser import parse
from quadloom.plans.planner import TRIPLE, Context, Planner
from quadloom.storage import cut, written

Extractor = Callable[[DataFrame], DataFrame]


def default_extractors(query: A.Op) -> list[Extractor]:
    """Common, container, profile and endpoint predicates, and quads that match a pattern of the query."""
    wanted = [tuple(x.value if isinstance(x, A.Term) and x.kind != BNODE else None for x in (p.s, p.p, p.o)) for p in A.patterns(query)]
    every = traversal.COMMON + traversal.LDP + traversal.SOLID + traversal.ENDPOINT
    return [lambda q: traversal.predicate_links(q, every), lambda q: traversal.pattern_links(q, wanted)]


def adaptive_joins(op: A.Op) -> list[A.Join]:
    """Joins of plain patterns over the default graph, the topmost first; what stands below GRAPH, SERVICE or EXISTS sees other quads or rows."""
    if isinstance(op, A.Graph | A.Service | A.From | A.Expr):
        return []
    own = [op] if isinstance(op, A.Join) and len(op.parts) > 1 and all(isinstance(p, A.Pattern) for p in op.parts) else []
    below = [x for f in op.__dataclass_fields__ for x in ([getattr(op, f)] if not isinstance(getattr(op, f), list) else getattr(op, f)) if isinstance(x, A.Op)]
    return own + [j for x in below for j in adaptive_joins(x)]


class _Running:
    """An adaptive join of patterns, fed with the new quads of each round."""

    def __init__(self, parts: list[A.Pattern], config: RestartConfig) -> None:
        self.parts, self.known = parts, {}
        self.variables = list(dict.fromkeys(v for p in parts for v in p.variables()))
        self.join = AdaptiveJoin(self.plan, lambda sizes: ordering.smallest_connected(parts, sizes), None, config)

    def plan(self, operands: list[DataFrame], order: list[int]) -> DataFrame:
        made = [Solutions(operands[i], dict.fromkeys(self.parts[i].variables(), False)) for i in order]
        return reduce(joins.join, made).df.select(*[F.col(f"`{v}`") for v in self.variables])

    def feed(self, quads: DataFrame, statistics: list[Statistics]) -> None:
        """quads: triples that no earlier round had."""
        self.known = accumulate("append", self.known, {"datasets": statistics})
        sizes = [e if e != float("inf") else 0.0 for e in ordering.estimates(self.parts, self.known.get("datasets", []))]
        if self.join.selectivity is None and statistics:
            # Once and up front: how much of the operands' sum the most selective shared variable keeps.
            self.join.selectivity = min((selectivity(a, b, statistics[0]) for i, a in enumerate(self.parts) for b in self.parts[:i] if set(a.variables()) & set(b.variables())), default=1.0)
        planner = Planner(Context(quads.sparkSession, quads))
        self.join.round([planner.pattern(p).df for p in self.parts], sizes)

    def solutions(self) -> Solutions:
        return Solutions(self.join.emitted, dict.fromkeys(self.variables, False))


@dataclass
class LinkTraversal:
    """documents: all quads that can be dereferenced, src naming their document.

    family: the hashes of the Bloom summaries met. link_filters: rules learned on the way are noted here; without a list (None) no filter may run.
    restart: when the topmost join changes its order; skip_adaptive_join leaves all joins plain.
    """

    documents: DataFrame
    use_void: bool = True
    use_bloom: bool = True
    mode: str = "reference"
    family: str = "fnv"
    most_rounds: int | None = None
    extractors: list[Extractor] | None = None
    link_filters: list | None = field(default_factory=list)
    restart: RestartConfig = field(default_factory=RestartConfig)
    skip_adaptive_join: bool = False
    wrapped_operations: list = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    decisions: list[dict] = field(default_factory=list)

    def rounds(self, query: A.Op, seeds: list[str]) -> Iterator[DataFrame]:
        """Quads of the documents of each depth."""
        spark = self.documents.sparkSession
        extractors = self.extractors if self.extractors is not None else default_extractors(query)
        frontier = visited = cut(spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "url string"))
        metadata: DataFrame | None = None
        depth = 0
        while not frontier.isEmpty():
            new = written(self.documents.join(frontier.withColumnRenamed("url", "src"), "src", "left_semi").select(*self.documents.columns), "documents")
            yield new
            own = new.filter(F.startswith("p", F.lit(MEM)) | F.startswith("p", F.lit(VOID))).select("s", "p", "o", F.lit(depth).alias("seq"))
            if metadata is not None or not own.isEmpty():
                metadata = own if metadata is None else metadata.unionByName(own)
            links = new.limit(0).select(F.col("s").alias("url"))
            for extract in extractors:
                links = links.unionByName(extract(new).select(F.regexp_replace("url", "#.*$", "").alias("url")))
            links = self.keep(links.distinct(), metadata if metadata is not None else own, query, metadata is not None)
            frontier = cut(links.join(visited, "url", "left_anti"))
            self.trace.append({"round": depth, "documents": new.select("src").distinct().count(), "quads": new.count(), "links": frontier.count()})
            visited = visited.unionByName(frontier)
            depth += 1
            if self.most_rounds is not None and depth > self.most_rounds:
                break

    def visit(self, query: A.Op, seeds: list[str]) -> DataFrame:
        """Quads of the documents visited."""
        return reduce(DataFrame.unionByName, self.rounds(query, seeds), self.documents.limit(0))

    def keep(self, links: DataFrame, metadata: DataFrame, query: A.Op, any_metadata: bool = True) -> DataFrame:
        """Links that no rule learned so far denies; without any metadata there is no rule."""
        if not self.use_void and not self.use_bloom:
            return links
        linkfilters.require(self.link_filters)
        if not any_metadata:
            return links
        if self.use_void:
            rules = linkfilters.void_rules(metadata)
            self.link_filters[:] = [x for x in self.link_filters if x[0] != "void"] + [("void", rules)]
            links = linkfilters.deny(links, rules)
        if self.use_bloom:
            found = linkfilters.membership_summaries(metadata)
            summaries = found.withColumn("raw", F.try_to_binary("bitmap", F.lit("base64")))
            datasets = linkfilters.irrelevant_datasets(summaries, linkfilters.pattern_table(links.sparkSession, query), self.mode, self.family)
            self.link_filters[:] = [x for x in self.link_filters if x[0] != "bloom"] + [("bloom", datasets)]
            links = linkfilters.deny_prefixes(links, datasets)
        return links

    def query(self, text: str, seeds: list[str]) -> DataFrame | bool:
        op = parse(text)
        running: list[tuple[A.Join, _Running]] = []
        wrapped = list(self.wrapped_operations)
        for join in adaptive_joins(op):
            if gate(self.restart, join.parts, wrapped, self.skip_adaptive_join) is None:
                running.append((join, _Running(join.parts, self.restart)))
                wrapped += join.parts
        read = triples = None
        for depth, new in enumerate(self.rounds(op, seeds)):
            if running:
                # The default graph holds a triple once, however many documents say it.
                fresh = new.dropDuplicates(TRIPLE)
                fresh = written(fresh if triples is None else fresh.join(triples, TRIPLE, "left_anti").select(*new.columns), "triples")
                triples = fresh.select(*TRIPLE) if triples is None else triples.unionByName(fresh.select(*TRIPLE))
                asked = {p.p.value for join, _ in running for p in join.parts if isinstance(p.p, A.Term)}
                every = any(isinstance(p.p, A.Var) for join, _ in running for p in join.parts)
                seen = fresh if every else fresh.filter(F.col("p").isin(*asked))
                statistics = list(Statistics.collect(describe(seen.withColumn("src", F.lit(f"round {depth}")))).values())
                for _, one in running:
                    one.feed(fresh, statistics)
            read = new if read is None else read.unionByName(new)
        engine = Engine(self.documents.sparkSession, read if read is not None else self.documents.limit(0))
        for join, one in running:
            if one.join.emitted is not None:
                op = A.replaced(op, join, A.Given(one.solutions()))
                self.decisions.append({"patterns": len(join.parts), "trace": one.join.trace})
        return engine.query(op)

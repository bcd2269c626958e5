"""Library entry: an engine over one table of quads."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import update as updates
from quadloom.operators.cardinality import Statistics, describe
from quadloom.plans import algebra as A
from quadloom.plans.parser import parse, parse_update
from quadloom.plans.planner import Context, Planner
from quadloom.sources.tables import Tables


@dataclass
class Engine:
    """query() answers any query form; update() replaces the quads by a new version.

    quads: a DataFrame, or ``Tables``. distinct_graphs: no triple is in two graphs; where that isn't
    known (None), the engine looks once how many graphs there are.
    """

    spark: SparkSession
    quads: DataFrame | Tables
    join_order: str = "cardinality"
    statistics: list[Statistics] = field(default_factory=list)
    services: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    load: Callable[[str], DataFrame] | None = None
    link_filters: list = field(default_factory=list)
    distinct_graphs: bool | None = None
    tables: Tables | None = None

    def __post_init__(self) -> None:
        if isinstance(self.quads, Tables):
            self.tables, self.distinct_graphs = self.quads, True

    def frame(self) -> DataFrame:
        """The quads as a DataFrame; of tables only where something needs them."""
        return self.quads.quads if isinstance(self.quads, Tables) else self.quads

    @classmethod
    def from_config(cls, spark: SparkSession, quads: DataFrame, path: str) -> Engine:
        """Options (join_order) from a JSON file that Spark can read."""
        text = "\n".join(r[0] for r in spark.read.text(path).collect())
        return cls(spark, quads, **{k: v for k, v in json.loads(text).items() if k in ("join_order",)})

    def analyze(self) -> Engine:
        """Collect statistics, which order join operands from then on: one row per predicate, however many sources there are."""
        self.statistics = list(Statistics.collect(describe(self.frame().withColumn("src", F.lit("all")))).values())
        return self

    def context(self) -> Context:
        if self.distinct_graphs is None:
            self.distinct_graphs = self.quads.select("g").distinct().limit(2).count() < 2
        return Context(self.spark, self.quads, self.distinct_graphs, self.tables, self.statistics, self.join_order, self.services, link_filters=self.link_filters)

    def query(self, query: str | A.Op) -> DataFrame | bool:
        """SELECT: term columns; CONSTRUCT and DESCRIBE: triples; ASK: a boolean."""
        op = parse(query) if isinstance(query, str) else query
        planner, inner = Planner(self.context()), op
        if isinstance(op, A.From):
            planner, inner = planner.within(default_graphs=op.default, named_graphs=op.named), op.child
        if isinstance(inner, A.Ask):
            return planner.ask(inner.child)
        if isinstance(inner, A.Construct):
            return planner.construct(inner)
        if isinstance(inner, A.Describe):
            return planner.describe(inner)
        return planner.run(op).df

    def update(self, text: str) -> Engine:
        for one in parse_update(text):
            self.quads = updates.apply(self.frame(), one, self.load)
        self.tables = self.distinct_graphs = None
        return self

    def save(self, path: str) -> Engine:
        """The quads as a new Parquet table, written by Spark's committer, and read from then on; an update's destination."""
        quads = self.frame()
        quads.write.parquet(path)
        self.quads = self.spark.read.schema(quads.schema).parquet(path)
        return self

    def invalidate(self) -> None:
        """Drop what Spark has cached, so that sources are read again."""
        self.spark.catalog.clearCache()
        self.statistics = []


def values(df: DataFrame, **types: str) -> DataFrame:
    """Lexical values of term columns; name=type casts one (``try_cast``)."""
    return df.select(*[F.col(f"`{c}`.value").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`.value").alias(c) for c in df.columns])

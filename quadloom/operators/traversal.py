"""Link traversal over a document table, breadth first, one round per depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.storage import cut

# Predicates whose objects lead on.
COMMON = ("http://www.w3.org/2000/01/rdf-schema#seeAlso", "http://www.w3.org/2002/07/owl#sameAs", "http://xmlns.com/foaf/0.1/isPrimaryTopicOf", "http://xmlns.com/foaf/0.1/page")
LDP = ("http://www.w3.org/ns/ldp#contains",)
SOLID = ("http://www.w3.org/ns/pim/space#storage", "http://www.w3.org/ns/solid/terms#publicTypeIndex", "http://www.w3.org/ns/solid/terms#instance", "http://www.w3.org/ns/solid/terms#instanceContainer")
ENDPOINT = ("http://rdfs.org/ns/void#sparqlEndpoint",)


def predicate_links(quads: DataFrame, predicates: tuple[str, ...], check_subject: bool = False) -> DataFrame:
    """Objects (IRIs) of these predicates as links; check_subject: only where the subject is the document."""
    found = quads.filter(F.col("p").isin(*predicates) & (F.col("o_kind") == 2))
    found = found.filter(F.col("s") == F.col("src")) if check_subject else found
    return found.select("src", F.col("o").alias("url")).distinct()


def all_links(quads: DataFrame) -> DataFrame:
    """Every IRI in subject, predicate or object position."""
    return quads.select("src", F.explode(F.array(F.when(F.col("s_kind") == 2, F.col("s")), F.col("p"), F.when(F.col("o_kind") == 2, F.col("o")))).alias("url")).filter("url is not null").distinct()


def pattern_links(quads: DataFrame, patterns: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """IRIs of quads that match a pattern of the query (None: a variable)."""
    hit = F.lit(False)
    for s, p, o in patterns:
        one = F.lit(True)
        for name, x in (("s", s), ("p", p), ("o", o)):
            one = one & (F.col(name) == x) if x is not None else one
        hit = hit | one
    return all_links(quads.filter(hit))


def html_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """href values of a page's anchors, in any quotes."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(F.col(url).alias("src"), F.explode(found).alias("url"))


def traverse(links: DataFrame, seeds: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, most_rounds: int | None = None) -> DataFrame:
    """url and depth of every document reached from seeds (url), each once at its least depth.

    links: src, url. keep filters a frontier (a deny list) before it is compared with what has been
    visited. Each round is cut by a reliable checkpoint.
    """
    keep = keep or (lambda df: df)
    links = links.select("src", "url").distinct()
    visited = frontier = cut(keep(seeds.select("url").distinct()).withColumn("depth", F.lit(0)))
    depth = 0
    while (most_rounds is None or depth < most_rounds) and not frontier.isEmpty():
        depth += 1
        found = frontier.select(F.col("url").alias("src")).join(links, "src").select("url").distinct()
        frontier = cut(keep(found).join(visited, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        visited = visited.unionByName(frontier)
    return visited

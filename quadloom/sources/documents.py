"""Whole documents as quads: Turtle, TriG, N-Quads, RDF/XML, JSON-LD and HTML with embedded JSON-LD.

These syntaxes need a document at once, so each row (url, content, media type) is parsed in Python
workers; documents are spread over tasks and a malformed one gives no quads.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape as html_unescape
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from quadloom.model import BOOLEAN, DOUBLE, INTEGER, LANG_STRING, QUADS, RDF_TYPE, STRING
from quadloom.plans import algebra as A
from quadloom.plans.parser import Parser
from quadloom.sources.datasource import parse_line

RDF = RDF_TYPE.removesuffix("type")
XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
Quad = tuple[A.Term | None, A.Term, str, A.Term]


class _Turtle(Parser):
    """Turtle and TriG share the triples grammar with query texts; blank nodes stay blank nodes."""

    def __init__(self, source: str, base: str) -> None:
        super().__init__(source)
        self.base, self.out = base, []

    def new_var(self) -> A.Term:
        self.fresh += 1
        return A.blank(f"t{self.fresh}")

    def document(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, word = self.peek()
            if (kind == "lang" and word in ("@prefix", "@base")) or self.is_word("PREFIX", "BASE"):
                self.next()
                if word.lower().endswith("prefix"):
                    name = self.next()[1].removesuffix(":")
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                self.mark(".")
            elif self.word("GRAPH"):
                self.block(self.term())
            elif kind in ("iri", "name", "blank") and self.peek(1) == ("mark", "{"):
                self.block(self.term())
            elif self.peek() == ("mark", "{"):
                self.block(None)
            else:
                self.statement(None)
                self.need(".")
        return self.out

    def block(self, graph: A.Term | None) -> None:
        self.need("{")
        while not self.mark("}"):
            self.statement(graph)
            self.mark(".")

    def statement(self, graph: A.Term | None) -> None:
        found: list = []
        opened = self.peek()[1] in "[("
        subject = self.node(found)
        if not (opened and found and self.peek()[1] in (".", "}")):
            self.properties(subject, found)
        self.out += [(graph, x.s, x.p.value, x.o) for x in found]


def turtle(text: str, base: str) -> list[Quad]:
    return _Turtle(text, base).document()


def rdf_xml(text: str, base: str) -> list[Quad]:
    out: list[Quad] = []
    fresh = iter(range(1 << 60))
    name = lambda tag: tag[1:].replace("}", "", 1)
    at = lambda e, key: e.get(f"{{{RDF}}}{key}")

    def subject_of(e) -> A.Term:
        if at(e, "about") is not None:
            return A.named(urljoin(base, at(e, "about")))
        if at(e, "ID") is not None:
            return A.named(urljoin(base, "#" + at(e, "ID")))
        return A.blank(at(e, "nodeID") or f"x{next(fresh)}")

    def node(e, lang: str) -> A.Term:
        subject, lang = subject_of(e), e.get(XML_LANG, lang)
        if name(e.tag) != RDF + "Description":
            out.append((None, subject, RDF_TYPE, A.named(name(e.tag))))
        properties(e, subject, lang)
        return subject

    def properties(e, subject: A.Term, lang: str) -> None:
        for key, value in e.attrib.items():
            if key[:1] == "{" and not key.startswith(f"{{{RDF}}}") and key != XML_LANG:
                out.append((None, subject, name(key), A.text(value, LANG_STRING if lang else STRING, lang.lower())))
        for n, p in enumerate(e, 1):
            predicate, tongue = name(p.tag), p.get(XML_LANG, lang)
            predicate = f"{RDF}_{n}" if predicate == RDF + "li" else predicate
            kind = at(p, "parseType")
            if at(p, "resource") is not None:
                value = A.named(urljoin(base, at(p, "resource")))
            elif at(p, "nodeID") is not None:
                value = A.blank(at(p, "nodeID"))
            elif kind == "Resource":
                value = A.blank(f"x{next(fresh)}")
                properties(p, value, tongue)
            elif kind == "Collection":
                items = [node(c, tongue) for c in p]
                value = A.named(RDF + "nil")
                for item in reversed(items):
                    cell = A.blank(f"x{next(fresh)}")
                    out.extend([(None, cell, RDF + "first", item), (None, cell, RDF + "rest", value)])
                    value = cell
            elif len(p):
                value = node(p[0], tongue)
            elif at(p, "datatype"):
                value = A.text(p.text or "", at(p, "datatype"))
            else:
                value = A.text(p.text or "", LANG_STRING if tongue else STRING, tongue.lower())
            out.append((None, subject, predicate, value))

    root = ElementTree.fromstring(text)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e, root.get(XML_LANG, ""))
    return out


def json_ld(text: str, base: str) -> list[Quad]:
    """The common core: inline contexts with terms, prefixes, @vocab, @base, @type and @language coercion, @list and @graph. Remote contexts are not fetched."""
    out: list[Quad] = []
    fresh = iter(range(1 << 60))

    def merge(context: dict, more) -> dict:
        for one in more if isinstance(more, list) else [more]:
            context = context | one if isinstance(one, dict) else context
        return context

    def expand(word: str, context: dict, vocabulary: bool) -> str:
        known = context.get(word) if vocabulary else None
        known = known.get("@id") if isinstance(known, dict) else known
        if known and known != word:
            return expand(known, context, True)
        prefix, colon, rest = word.partition(":")
        if colon and prefix in context and not rest.startswith("//"):
            return expand(prefix, context, True) + rest
        if colon:
            return word
        return context["@vocab"] + word if vocabulary and context.get("@vocab") else urljoin(context.get("@base") or base, word)

    def ident(word: str, context: dict) -> A.Term:
        return A.blank(word[2:]) if word.startswith("_:") else A.named(expand(word, context, False))

    def value(x, context: dict, rule: dict, graph) -> A.Term | None:
        if isinstance(x, dict) and "@value" in x:
            lang = x.get("@language", "")
            return scalar(x["@value"], expand(x["@type"], context, True) if "@type" in x else "", lang)
        if isinstance(x, dict) and "@list" in x:
            tail = A.named(RDF + "nil")
            for item in reversed(x["@list"] if isinstance(x["@list"], list) else [x["@list"]]):
                cell = A.blank(f"j{next(fresh)}")
                out.extend([(graph, cell, RDF + "first", value(item, context, rule, graph)), (graph, cell, RDF + "rest", tail)])
                tail = cell
            return tail
        if isinstance(x, dict):
            return node(x, context, graph)
        if rule.get("@type") in ("@id", "@vocab") and isinstance(x, str):
            return ident(x, context) if rule["@type"] == "@id" else A.named(expand(x, context, True))
        dt = expand(rule["@type"], context, True) if rule.get("@type") else ""
        return scalar(x, dt, "" if dt else rule.get("@language", context.get("@language", "")) or "")

    def scalar(x, dt: str, lang: str) -> A.Term:
        if isinstance(x, bool):
            return A.text(str(x).lower(), dt or BOOLEAN)
        if isinstance(x, int | float):
            return A.text(str(int(x)) if float(x).is_integer() and dt != DOUBLE else repr(float(x)), dt or (INTEGER if float(x).is_integer() else DOUBLE))
        return A.text(str(x), LANG_STRING, lang.lower()) if lang else A.text(str(x), dt or STRING)

    def node(x: dict, context: dict, graph) -> A.Term:
        context = merge(context, x["@context"]) if "@context" in x else context
        subject = ident(x["@id"], context) if "@id" in x else A.blank(f"j{next(fresh)}")
        for key, some in x.items():
            if key == "@type":
                for t in some if isinstance(some, list) else [some]:
                    out.append((graph, subject, RDF_TYPE, A.named(expand(t, context, True))))
            elif key == "@graph":
                for inner in some if isinstance(some, list) else [some]:
                    node(inner, context, subject if "@id" in x else graph)
            elif not key.startswith("@") and some is not None:
                rule = context.get(key) if isinstance(context.get(key), dict) else {}
                predicate = expand(key, context, True)
                if ":" not in predicate:
                    continue
                if rule.get("@container") == "@list" and not isinstance(some, dict):
                    some = {"@list": some}
                for one in some if isinstance(some, list) else [some]:
                    if one is not None:
                        out.append((graph, subject, predicate, value(one, context, rule, graph)))
        return subject

    loaded = json.loads(text)
    for one in loaded if isinstance(loaded, list) else [loaded]:
        node(one, {}, None)
    return out


def html(text: str, base: str) -> list[Quad]:
    """JSON-LD of script elements."""
    found = re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", text, re.S | re.I)
    return [q for part in found for q in json_ld(html_unescape(part), base)]


#: By media type.
PARSERS = {
    "text/turtle": turtle, "application/trig": turtle, "text/n3": turtle, "application/rdf+xml": rdf_xml, "application/ld+json": json_ld, "text/html": html, "application/xhtml+xml": html,
}
LINES = ("application/n-triples", "application/n-quads")


def rows(url: str, content: str, media_type: str) -> list[tuple]:
    """Flat quads of one document; blank nodes are its own."""
    if media_type in LINES:
        return [r for line in content.splitlines() if (r := parse_line(line, url))]
    own = lambda t: A.blank(f"{abs(hash_text(url)):x}-{t.value}") if t.kind == A.BNODE else t
    made = []
    for g, s, p, o in PARSERS[media_type](content, url):
        s, o = own(s), own(o)
        made.append((own(g).value if g else "", s.kind, s.value, p, o.kind, o.value, o.dt, o.lang, url))
    return made


def hash_text(text: str) -> int:
    """The same on every worker."""
    out = 0
    for b in text.encode():
        out = (out * 1_000_003 + b) % (1 << 61)
    return out


def parse_documents(docs: DataFrame, url: str = "url", content: str = "content", media_type: str = "media_type") -> DataFrame:
    """Quads of documents, src being their URL. Unknown media types and malformed documents give none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in QUADS.split(", ")]
        for pdf in batches:
            made = []
            for u, c, m in zip(pdf["url"], pdf["content"], pdf["media_type"], strict=True):
                kind = (m or "").split(";")[0].strip().lower()
                if u is None or c is None or kind not in PARSERS and kind not in LINES:
                    continue
                try:
                    made += rows(u, c, kind)
                except Exception:  # noqa: BLE001 - one broken document must not end the traversal
                    continue
            yield pd.DataFrame(made, columns=names)

    from pyspark.sql import functions as F

    return docs.select(F.col(url).alias("url"), F.col(content).alias("content"), F.col(media_type).alias("media_type")).mapInPandas(parse, QUADS)

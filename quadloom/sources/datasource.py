"""A Spark data source of quads from a fetch function: ``format("quadloom")``.

Each URL is one partition, so documents are read in parallel and retried by Spark. Online quad
pattern interfaces and SPARQL endpoints need a network; ``fetcher`` names an importable function
(url) -> iterable of N-Quads lines, which tests replace by an offline one.
"""

from __future__ import annotations

import importlib
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadloom.model import QUADS
from quadloom.plans.parser import unescape

_LINE = re.compile(r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<([^>]*)>)?\s*\.')
_TYPES = "http://www.w3.org/2001/XMLSchema#string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


def file_lines(url: str):
    with open(url.removeprefix("file://"), encoding="utf-8") as file:
        yield from file


def parse_line(line: str, src: str) -> tuple | None:
    m = _LINE.match(line)
    if not m:
        return None
    term = lambda t: (2, t[1:-1]) if t[0] == "<" else (1, t[2:]) if t[0] == "_" else (3, unescape(re.match(r'"((?:[^"\\]|\\.)*)"', t)[1]))
    (sk, s), (ok, o) = term(m[1]), term(m[3])
    lang, dt = re.search(r'"@([A-Za-z0-9-]+)$', m[3]), re.search(r'"\^\^<([^>]*)>$', m[3])
    return m[4] or "", sk, s, m[2], ok, o, "" if ok != 3 else _TYPES[1] if lang else dt[1] if dt else _TYPES[0], lang[1].lower() if lang and ok == 3 else "", src


class QuadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quadloom"

    def schema(self) -> str:
        return QUADS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split(" ") if u]
        self.fetcher = options.get("fetcher", "quadloom.sources.datasource:file_lines")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        module, _, name = self.fetcher.partition(":")
        for line in getattr(importlib.import_module(module), name)(partition.value):
            if (row := parse_line(line, partition.value)) is not None:
                yield row

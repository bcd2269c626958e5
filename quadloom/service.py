"""SPARQL protocol over HTTP: python -m quadloom.service --data FILE [--port 3000]

GET and POST queries (parameter ``query``, a form, or a body of application/sparql-query); POST updates (``update`` or
application/sparql-update) where --update is given. Results as JSON, XML, CSV or TSV; triples as N-Quads, Turtle or JSON-LD.
"""

from __future__ import annotations

import argparse
import json
from functools import reduce
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from quadloom.engine import Engine
from quadloom.sources import rdf

JSON, CSV, TSV, QUADS = "application/sparql-results+json", "text/csv", "text/tab-separated-values", "application/n-quads"
XML, TURTLE, JSONLD = "application/sparql-results+xml", "text/turtle", "application/ld+json"


def answer(engine: Engine, query: str, accept: str):
    """Media type and lines of a result, as they come from Spark."""
    found = engine.query(query)
    if isinstance(found, bool):
        return JSON, iter([json.dumps({"head": {}, "boolean": found})])
    if "s_kind" in found.columns and JSONLD in accept:
        return JSONLD, (line for part in (["["], (("," if n else "") + r[0] + "\n" for n, r in enumerate(rdf.to_jsonld(found).toLocalIterator())), ["]"]) for line in part)
    if "s_kind" in found.columns and TURTLE in accept:
        return TURTLE, (row[0] + "\n" for row in rdf.to_turtle(found).toLocalIterator())
    if "s_kind" not in found.columns and XML in accept:
        before, behind = rdf.xml_frame(found.columns)
        return XML, (line for part in ([before], (r[0] + "\n" for r in rdf.results_xml(found).toLocalIterator()), [behind]) for line in part)
    if "s_kind" in found.columns:
        return QUADS, (row[0] + "\n" for row in rdf.to_lines(found).toLocalIterator())
    if CSV in accept or TSV in accept:
        csv = CSV in accept
        rows = (rdf.results_csv if csv else rdf.results_tsv)(found).toLocalIterator()
        head = ",".join(found.columns) if csv else "\t".join(f"?{c}" for c in found.columns)
        return CSV if csv else TSV, (line for part in ([head + "\n"], (r[0] + "\n" for r in rows)) for line in part)

    def lines():
        yield json.dumps({"vars": found.columns}).join(['{"head":', ',"results":{"bindings":['])
        for n, row in enumerate(rdf.results_json(found).toLocalIterator()):
            yield ("," if n else "") + row[0]
        yield "]}}"

    return JSON, lines()


def server(engine: Engine, port: int = 3000, host: str = "127.0.0.1", updates: bool = False) -> ThreadingHTTPServer:
    lock = Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def do_GET(self) -> None:  # noqa: N802
            self.serve({k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()})

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            kind = self.headers.get("Content-Type", "").split(";")[0]
            whole = {"application/sparql-query": "query", "application/sparql-update": "update"}
            self.serve({whole[kind]: body} if kind in whole else {k: v[0] for k, v in parse_qs(body).items()}, True)

        def serve(self, given: dict[str, str], posted: bool = False) -> None:
            try:
                if "update" in given and posted and updates:
                    with lock:
                        engine.update(given["update"])
                    self.reply(200, "text/plain", iter(["ok\n"]))
                elif "query" in given:
                    self.reply(200, *answer(engine, given["query"], self.headers.get("Accept", "")))
                else:
                    self.reply(400, "text/plain", iter(["a query is needed\n"]))
            except Exception as error:  # noqa: BLE001 - the client learns what was wrong
                self.reply(400, "text/plain", iter([f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}\n"]))

        def reply(self, status: int, media_type: str, lines) -> None:
            first = next(lines, "")
            self.send_response(status)
            self.send_header("Content-Type", f"{media_type}; charset=utf-8")
            self.end_headers()
            self.wfile.write(first.encode())
            for line in lines:
                self.wfile.write(line.encode())

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    parser = argparse.ArgumentParser(prog="quadloom.service")
    parser.add_argument("--data", action="append", required=True)
    parser.add_argument("--port", type=int, default=3000)
    parser.add_argument("--update", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("quadloom").getOrCreate()
    engine = Engine(spark, reduce(DataFrame.unionByName, [rdf.read(spark, p) for p in args.data]))
    with server(engine, args.port, updates=args.update) as running:
        running.serve_forever()


if __name__ == "__main__":
    main()

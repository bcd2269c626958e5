"""SPARQL 1.1 text to algebra, by recursive descent."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quadloom.model import BOOLEAN, DECIMAL, DOUBLE, INTEGER, LANG_STRING, RDF_TYPE, STRING
from quadloom.plans import algebra as A

TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<var>[?$]\w+)|(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)|(?P<blank>_:[\w.-]*\w)"""
    r"""|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>[A-Za-z_]\w*)|(?P<mark>\^\^|\|\||&&|!=|<=|>=|[{}()\[\].,;=<>!+*/|^?-])""",
    re.X,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")


class SyntaxProblem(ValueError):
    pass


def unescape(body: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), body, flags=re.S)


class Parser:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise SyntaxProblem(f"at {source[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.prefixes, self.fresh = 0, "", {}, 0
        self.aggregates: list[tuple[str, A.Aggregate]] | None = None

    # Tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def is_word(self, *words: str) -> bool:
        kind, value = self.peek()
        return kind == "word" and value.upper() in words

    def word(self, *words: str) -> str | None:
        return self.next()[1].upper() if self.is_word(*words) else None

    def mark(self, *marks: str) -> str | None:
        kind, value = self.peek()
        return self.next()[1] if kind == "mark" and value in marks else None

    def need(self, *what: str) -> str:
        if found := self.mark(*what) or self.word(*what):
            return found
        raise SyntaxProblem(f"expected {' or '.join(what)}, found {self.peek()[1]!r}")

    def new_var(self) -> A.Var:
        self.fresh += 1
        return A.Var(f"__{self.fresh}")

    # Terms
    def iri(self) -> str:
        kind, value = self.next()
        if kind == "iri":
            return urljoin(self.base, value[1:-1]) if self.base else value[1:-1]
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        raise SyntaxProblem(f"expected an IRI, found {value!r}")

    def term(self) -> A.Node:
        kind, value = self.peek()
        if kind == "var":
            self.next()
            return A.Var(value[1:])
        if kind in ("iri", "name"):
            return A.named(self.iri())
        if kind == "blank":
            self.next()
            return A.blank(value[2:])
        if kind == "string":
            self.next()
            body = unescape(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.peek()[0] == "lang":
                return A.text(body, LANG_STRING, self.next()[1][1:].lower())
            return A.text(body, self.iri() if self.mark("^^") else STRING)
        sign = self.mark("-", "+") or "" if value in "+-" and self.peek(1)[0] == "number" else ""
        kind, value = self.peek()
        if kind == "number":
            self.next()
            return A.text(sign.replace("+", "") + value, DOUBLE if re.search("[eE]", value) else DECIMAL if "." in value else INTEGER)
        if word := self.word("TRUE", "FALSE"):
            return A.text(word.lower(), BOOLEAN)
        raise SyntaxProblem(f"expected a term, found {value!r}")

    # Patterns
    def as_var(self, node: A.Node) -> A.Node:
        """Blank nodes in patterns are variables that nobody else sees."""
        return A.Var(f"__b_{node.value}") if isinstance(node, A.Term) and node.kind == A.BNODE else node

    def node(self, out: list[A.Op]) -> A.Node:
        if self.mark("["):
            subject = self.new_var()
            if not self.mark("]"):
                self.properties(subject, out)
                self.need("]")
            return subject
        if self.mark("("):
            items = []
            while not self.mark(")"):
                items.append(self.node(out))
            rdf = RDF_TYPE.removesuffix("type")
            rest: A.Node = A.named(rdf + "nil")
            for item in reversed(items):
                cell = self.new_var()
                out += [A.Pattern(cell, A.named(rdf + "first"), item), A.Pattern(cell, A.named(rdf + "rest"), rest)]
                rest = cell
            return rest
        return self.term()

    def properties(self, subject: A.Node, out: list[A.Op]) -> None:
        while True:
            verb = self.verb()
            while True:
                value = self.node(out)
                if isinstance(verb, A.Path):
                    out.append(A.PathPattern(subject, verb, value))
                else:
                    out.append(A.Pattern(subject, verb, value))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.peek()[1] in (".", "]", "}", ")") and self.peek()[0] == "mark":
                return

    def verb(self) -> A.Node | A.Path:
        if self.peek()[0] == "var":
            return self.term()
        path = self.path()
        return A.named(path.iri) if path.kind == "link" else path

    def path(self) -> A.Path:
        parts = [self.path_sequence()]
        while self.mark("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Path("alt", tuple(parts))

    def path_sequence(self) -> A.Path:
        parts = [self.path_step()]
        while self.mark("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else A.Path("seq", tuple(parts))

    def path_step(self) -> A.Path:
        inverse = self.mark("^")
        if self.mark("("):
            path = self.path()
            self.need(")")
        elif self.mark("!"):
            several = self.mark("(")
            links = []
            while True:
                back = self.mark("^")
                link = self.path_link()
                links.append(A.Path("inverse", (link,)) if back else link)
                if not several or not self.mark("|"):
                    break
            if several:
                self.need(")")
            path = A.Path("not", tuple(links))
        else:
            path = self.path_link()
        if mod := self.mark("?", "*", "+"):
            path = A.Path({"?": "opt", "*": "star", "+": "plus"}[mod], (path,))
        return A.Path("inverse", (path,)) if inverse else path

    def path_link(self) -> A.Path:
        if self.peek() == ("word", "a"):
            self.next()
            return A.Path("link", iri=RDF_TYPE)
        return A.Path("link", iri=self.iri())

    def triples(self) -> list[A.Op]:
        out: list[A.Op] = []
        while not (self.peek()[0] == "mark" and self.peek()[1] == "}") and not self.is_word("OPTIONAL", "MINUS", "FILTER", "BIND", "VALUES", "GRAPH", "SERVICE", "UNION") and self.peek() != ("mark", "{"):
            before = len(out)
            opened = self.peek()[1] in "[("
            subject = self.node(out)
            if not (opened and len(out) > before and self.peek()[1] in (".", "}")):
                self.properties(subject, out)
            if not self.mark("."):
                break
        return [type(x)(self.as_var(x.s), x.path if isinstance(x, A.PathPattern) else self.as_var(x.p), self.as_var(x.o)) for x in out]

    def group(self) -> A.Op:
        self.need("{")
        if self.is_word("SELECT"):
            found = self.select()
            self.need("}")
            return found
        now: A.Op = A.Join([])
        filters: list[A.Expr] = []

        def joined(right: A.Op) -> A.Op:
            left = now.parts if isinstance(now, A.Join) else [now]
            return A.Join([*left, *(right.parts if isinstance(right, A.Join) else [right])])

        while not self.mark("}"):
            if self.word("OPTIONAL"):
                right = self.group()
                now = A.LeftJoin(now, right.child, right.condition) if isinstance(right, A.Filter) else A.LeftJoin(now, right)
            elif self.word("MINUS"):
                now = A.Minus(now, self.group())
            elif self.word("FILTER"):
                filters.append(self.constraint())
            elif self.word("BIND"):
                self.need("(")
                value = self.expression()
                self.need("AS")
                now = A.Extend(now, self.next()[1][1:], value)
                self.need(")")
            elif self.is_word("VALUES"):
                now = joined(self.values())
            elif self.word("GRAPH"):
                name = self.term()
                now = joined(A.Graph(name, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                name = self.term()
                now = joined(A.Service(name, self.group(), silent))
            elif self.peek() == ("mark", "{"):
                parts = [self.group()]
                while self.word("UNION"):
                    parts.append(self.group())
                now = joined(A.Union(parts) if len(parts) > 1 else parts[0])
            elif not self.mark("."):
                now = joined(A.Join(self.triples()))
        if filters:
            whole = filters[0]
            for f in filters[1:]:
                whole = A.Call("&&", (whole, f))
            now = A.Filter(now, whole)
        return now

    def values(self) -> A.Values:
        self.need("VALUES")
        several = self.peek()[0] != "var"
        names = []
        if several:
            self.need("(")
            while not self.mark(")"):
                names.append(self.next()[1][1:])
        else:
            names.append(self.next()[1][1:])
        self.need("{")
        rows = []
        while not self.mark("}"):
            if several:
                self.need("(")
            row = [None if self.word("UNDEF") else self.term() for _ in names]
            if several:
                self.need(")")
            rows.append(row)
        return A.Values(names, rows)

    # Expressions
    def constraint(self) -> A.Expr:
        if self.peek() == ("mark", "("):
            self.next()
            found = self.expression()
            self.need(")")
            return found
        return self.primary()

    def expression(self) -> A.Expr:
        left = self.conjunction()
        while self.mark("||"):
            left = A.Call("||", (left, self.conjunction()))
        return left

    def conjunction(self) -> A.Expr:
        left = self.relation()
        while self.mark("&&"):
            left = A.Call("&&", (left, self.relation()))
        return left

    def relation(self) -> A.Expr:
        left = self.sum()
        if op := self.mark("=", "!=", "<", ">", "<=", ">="):
            return A.Call(op, (left, self.sum()))
        negated = bool(self.is_word("NOT") and self.word("NOT"))
        if self.word("IN"):
            return A.Call("NOT IN" if negated else "IN", (left, *self.arguments()))
        return left

    def sum(self) -> A.Expr:
        left = self.product()
        while op := self.mark("+", "-"):
            left = A.Call(op, (left, self.product()))
        return left

    def product(self) -> A.Expr:
        left = self.unary()
        while op := self.mark("*", "/"):
            left = A.Call(op, (left, self.unary()))
        return left

    def unary(self) -> A.Expr:
        if op := self.mark("!", "-", "+"):
            return A.Call("U" + op, (self.unary(),)) if op != "+" else self.unary()
        return self.primary()

    def arguments(self) -> list[A.Expr]:
        self.need("(")
        out = []
        while not self.mark(")"):
            out.append(self.expression())
            self.mark(",")
        return out

    def primary(self) -> A.Expr:
        kind, value = self.peek()
        if self.mark("("):
            found = self.expression()
            self.need(")")
            return found
        if kind == "word" and value.upper() not in ("TRUE", "FALSE"):
            name = self.next()[1].upper()
            if name == "NOT":
                self.need("EXISTS")
                return A.Exists(self.group(), True)
            if name == "EXISTS":
                return A.Exists(self.group())
            if name in AGGREGATES:
                return self.aggregate(name)
            return A.Call(name, tuple(self.arguments()))
        if kind in ("iri", "name"):
            name = self.iri()
            return A.Call(name, tuple(self.arguments())) if self.peek() == ("mark", "(") else A.Value(A.named(name))
        return A.Value(self.term())

    def aggregate(self, name: str) -> A.Expr:
        if self.aggregates is None:
            raise SyntaxProblem(f"{name} outside a projection or HAVING")
        self.need("(")
        distinct = bool(self.word("DISTINCT"))
        arg = None if self.mark("*") else self.expression()
        separator = " "
        if self.mark(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.term().value
        self.need(")")
        out = A.Aggregate(name, arg, distinct, separator)
        for known, same in self.aggregates:
            if same == out:
                return A.Value(A.Var(known))
        self.aggregates.append((f"__agg_{len(self.aggregates)}", out))
        return A.Value(A.Var(self.aggregates[-1][0]))

    # Queries
    def prologue(self) -> None:
        while word := self.word("BASE", "PREFIX"):
            if word == "BASE":
                self.base = self.next()[1][1:-1]
            else:
                name = self.next()[1].removesuffix(":")
                self.prefixes[name] = self.iri()

    def dataset(self) -> tuple[list[str], list[str]]:
        default, names = [], []
        while self.word("FROM"):
            (names if self.word("NAMED") else default).append(self.iri())
        return default, names

    def select(self) -> A.Op:
        self.need("SELECT")
        mode = self.word("DISTINCT", "REDUCED")
        outer, self.aggregates = self.aggregates, []
        names: list[str] = []
        computed: list[tuple[str, A.Expr]] = []
        if self.mark("*"):
            names = ["*"]
        else:
            while self.peek()[0] == "var" or self.peek() == ("mark", "("):
                if self.mark("("):
                    value = self.expression()
                    self.need("AS")
                    name = self.next()[1][1:]
                    self.need(")")
                    computed.append((name, value))
                    names.append(name)
                else:
                    names.append(self.next()[1][1:])
        default, graphs = self.dataset()
        self.word("WHERE")
        op = self.modified(self.group(), names, computed, mode)
        self.aggregates = outer
        return A.From(op, default, graphs) if default or graphs else op

    def modified(self, op: A.Op, names: list[str] | None, computed: list[tuple[str, A.Expr]], mode: str | None = None) -> A.Op:
        keys: list[tuple[str, A.Expr]] = []
        having: list[A.Expr] = []
        order: list[tuple[A.Expr, bool]] = []
        grouped = False
        if self.word("GROUP"):
            self.need("BY")
            grouped = True
            while self.peek()[0] == "var" or self.peek() == ("mark", "(") or (self.peek()[0] in ("word", "iri", "name") and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES")):
                if self.mark("("):
                    value = self.expression()
                    name = self.next()[1][1:] if self.word("AS") else self.new_var().name
                    self.need(")")
                elif self.peek()[0] == "var":
                    name = self.next()[1][1:]
                    value = A.Value(A.Var(name))
                else:
                    value, name = self.primary(), self.new_var().name
                keys.append((name, value))
        if self.word("HAVING"):
            while self.peek() == ("mark", "(") or (self.peek()[0] in ("word", "iri", "name") and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES")):
                having.append(self.constraint())
        if self.word("ORDER"):
            self.need("BY")
            while not self.is_word("LIMIT", "OFFSET", "VALUES") and self.peek()[0] != "end" and self.peek() != ("mark", "}"):
                down = self.word("ASC", "DESC") == "DESC"
                order.append((self.constraint(), not down))
        limit, offset = None, 0
        while word := self.word("LIMIT", "OFFSET"):
            n = int(self.next()[1])
            limit, offset = (n, offset) if word == "LIMIT" else (limit, n)
        tail = self.values() if self.is_word("VALUES") else None
        if grouped or self.aggregates:
            op = A.Group(op, keys, list(self.aggregates or []))
        for h in having:
            op = A.Filter(op, h)
        if tail:
            op = A.Join([op, tail])
        for name, value in computed:
            op = A.Extend(op, name, value)
        if order:
            op = A.OrderBy(op, order)
        if names is not None:
            op = A.Project(op, names)
        if mode:
            op = A.Distinct(op) if mode == "DISTINCT" else A.Reduced(op)
        return A.Slice(op, offset, limit) if offset or limit is not None else op

    def template(self) -> list[A.Pattern]:
        self.need("{")
        out: list[A.Op] = []
        while not self.mark("}"):
            self.properties(self.node(out), out)
            self.mark(".")
        return out

    def query(self) -> A.Op:
        self.prologue()
        if self.is_word("SELECT"):
            op = self.select()
        elif self.word("ASK"):
            default, graphs = self.dataset()
            self.word("WHERE")
            op = A.Ask(self.group())
            op = A.From(op, default, graphs) if default or graphs else op
        elif self.word("CONSTRUCT"):
            if self.peek() == ("mark", "{"):
                template = self.template()
                default, graphs = self.dataset()
                self.word("WHERE")
                self.aggregates = []
                op = A.Construct(self.modified(self.group(), None, []), template)
            else:
                default, graphs = self.dataset()
                self.need("WHERE")
                where = self.group()
                op = A.Construct(where, A.patterns(where))
            op = A.From(op, default, graphs) if default or graphs else op
        elif self.word("DESCRIBE"):
            terms = []
            while self.peek()[0] in ("var", "iri", "name"):
                terms.append(self.term())
            self.mark("*")
            default, graphs = self.dataset()
            where = self.group() if self.word("WHERE") or self.peek() == ("mark", "{") else None
            op = A.Describe(where, terms)
            op = A.From(op, default, graphs) if default or graphs else op
        else:
            raise SyntaxProblem(f"expected a query form, found {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"unexpected {self.peek()[1]!r}")
        return op

    # Updates
    def quads(self) -> list[tuple[A.Node | None, A.Pattern]]:
        """Template quads (graph, pattern) of a brace block."""
        self.need("{")
        out: list[tuple[A.Node | None, A.Pattern]] = []
        while not self.mark("}"):
            if self.word("GRAPH"):
                graph = self.term()
                out += [(graph, p) for p in self.template()]
            else:
                some: list[A.Op] = []
                self.properties(self.node(some), some)
                out += [(None, p) for p in some]
            self.mark(".")
        return out

    def graph_ref(self) -> str | None:
        """An IRI, '' for the default graph, NAMED or ALL."""
        if word := self.word("DEFAULT", "NAMED", "ALL"):
            return "" if word == "DEFAULT" else word
        self.word("GRAPH")
        return self.iri()

    def update(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.one_update())
            self.mark(";")

    def one_update(self) -> A.Update:
        graph = self.iri() if self.word("WITH") else None
        word = self.need("INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD")
        under = lambda quads: [(g or (A.named(graph) if graph else None), p) for g, p in quads]
        if word in ("INSERT", "DELETE"):
            if self.word("DATA"):
                quads = self.quads()
                return A.Update(word.lower(), **{word.lower(): quads})
            if word == "DELETE" and self.word("WHERE"):
                quads = under(self.quads())
                parts = [A.Graph(g, p) if g else p for g, p in quads]
                return A.Update("modify", delete=quads, where=A.Join(parts))
            first = under(self.quads())
            second = under(self.quads()) if word == "DELETE" and self.word("INSERT") else []
            while self.word("USING"):
                self.word("NAMED")
                graph = self.iri()
            self.need("WHERE")
            where = self.group()
            where = A.From(where, [graph], []) if graph else where
            return A.Update("modify", delete=first if word == "DELETE" else [], insert=second if word == "DELETE" else first, where=where)
        silent = bool(self.word("SILENT"))
        if word == "LOAD":
            source = self.iri()
            target = (self.word("GRAPH"), self.iri())[1] if self.word("INTO") else ""
            return A.Update("load", source=source, target=target, silent=silent)
        if word in ("CLEAR", "CREATE", "DROP"):
            return A.Update(word.lower(), target=self.graph_ref(), silent=silent)
        source = self.graph_ref()
        self.need("TO")
        return A.Update(word.lower(), source=source, target=self.graph_ref(), silent=silent)


def parse(source: str) -> A.Op:
    return Parser(source).query()


def parse_update(source: str) -> list[A.Update]:
    return Parser(source).update()

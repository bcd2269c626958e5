"""Scalar functions over term columns. An error is an unbound (null) result, never an exception.

Everything is built-in Spark expressions, so plans stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.model import BNODE, BOOLEAN, DATETIME, DECIMAL, DOUBLE, DURATION, FLOAT, INTEGER, INTEGERS, IRI, LANG_STRING, LITERAL, STRING, TERM, XSD, iri, literal, term


class V:
    """A value on the way: a term column, or a native boolean or number that becomes a term only when asked to.

    Nested logic and arithmetic thus stay native, and the fields of constants are constants that
    Catalyst folds; going through terms at each step would make plans grow exponentially.
    """

    def __init__(self, form: str, column: Column, rank: Column | int | None = None, exact: Column | None = None, fields: tuple | None = None) -> None:
        self.form, self.column, self.by, self.exact, self.fields = form, column, rank, exact, fields

    @classmethod
    def of(cls, column: Column) -> V:
        return cls("term", column)

    @classmethod
    def constant(cls, kind: int, value: str, dt: str, lang: str) -> V:
        out = cls("term", term(kind, F.lit(value), dt, lang), fields=(F.lit(kind), F.lit(value), F.lit(dt), F.lit(lang)))
        out.datatype = dt
        return out

    def fields_numeric(self) -> bool:
        """A constant with a numeric datatype."""
        return self.datatype in (*INTEGERS, DECIMAL, FLOAT, DOUBLE)

    @property
    def kind(self) -> Column:
        return self.fields[0] if self.fields else self.column["kind"] if self.form == "term" else F.when(self.column.isNotNull(), LITERAL)

    @property
    def value(self) -> Column:
        if self.form == "bool":
            return self.column.cast("string")
        if self.form == "number":
            return self._written()
        return self.fields[1] if self.fields else self.column["value"]

    def __getitem__(self, name: str) -> Column:
        if self.form == "term":
            return self.fields[2 if name == "dt" else 3] if self.fields else self.column[name]
        if name == "lang":
            return F.lit("")
        return F.lit(BOOLEAN) if self.form == "bool" else self._datatype()

    def _datatype(self) -> Column:
        names = {1: INTEGER, 2: DECIMAL, 3: FLOAT, 4: DOUBLE}
        return F.lit(names[self.by]) if isinstance(self.by, int) else F.when(self.by == 1, INTEGER).when(self.by == 2, DECIMAL).when(self.by == 3, FLOAT).otherwise(DOUBLE)

    def _written(self) -> Column:
        x = self.column
        whole = self.exact.cast("string") if self.exact is not None else F.when(F.abs(x) < 9.0e18, x.cast("bigint").cast("string"))
        plain = F.when((x == F.floor(x)) & (F.abs(x) < 9.0e18), x.cast("bigint").cast("string")).otherwise(x.try_cast("decimal(38,18)").cast("string"))
        plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        real = F.when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(x.cast("string"))
        if isinstance(self.by, int):
            return {1: whole, 2: plain}.get(self.by, real)
        return F.when(self.by == 1, whole).when(self.by == 2, plain).otherwise(real)

    def term(self) -> Column:
        return self.column if self.form == "term" else literal(self.value, self["dt"])

    def isNull(self) -> Column:  # noqa: N802
        return self.column.isNull()

    def isNotNull(self) -> Column:  # noqa: N802
        return self.column.isNotNull()


def kind(x: V) -> Column:
    return x.kind


def value(x: V) -> Column:
    return x.value


def is_string(x: V) -> Column:
    return (kind(x) == LITERAL) & x["dt"].isin(STRING, LANG_STRING) if x.form == "term" else F.lit(False)


def is_numeric(x: V) -> Column:
    if x.form == "term":
        return (kind(x) == LITERAL) & x["dt"].isin(*INTEGERS, DECIMAL, FLOAT, DOUBLE)
    return x.isNotNull() if x.form == "number" else F.lit(False)


def rank(x: V) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; null for all else."""
    if x.form == "number":
        return F.lit(x.by) if isinstance(x.by, int) else x.by
    if x.form == "bool":
        return F.lit(None).cast("int")
    return F.when(kind(x) == LITERAL, F.when(x["dt"].isin(*INTEGERS), 1).when(x["dt"] == DECIMAL, 2).when(x["dt"] == FLOAT, 3).when(x["dt"] == DOUBLE, 4))


def number(x: V) -> Column:
    """As a double, null unless it is a well-formed numeric literal."""
    if x.form == "number":
        return x.column
    if x.form == "bool":
        return F.lit(None).cast("double")
    # Spark reads Infinity, the lexical form is INF.
    return F.when(is_numeric(x), F.replace(value(x), F.lit("INF"), F.lit("Infinity")).try_cast("double"))


def whole(x: V) -> Column:
    """An integer exactly, null for anything else."""
    if x.form == "number":
        return x.exact if x.exact is not None else F.lit(None).cast("bigint")
    return F.when(x["dt"].isin(*INTEGERS), value(x).try_cast("bigint")) if x.form == "term" else F.lit(None).cast("bigint")


def timestamp(x: V) -> Column:
    return F.when((kind(x) == LITERAL) & (x["dt"] == DATETIME), F.try_to_timestamp(value(x)))


def boolean(x: V) -> Column:
    """The value of an xsd:boolean literal."""
    if x.form == "bool":
        return x.column
    return F.when((kind(x) == LITERAL) & (x["dt"] == BOOLEAN), F.when(value(x).isin("true", "1"), True).when(value(x).isin("false", "0"), False))


def ebv(x: V) -> Column:
    """Effective boolean value; null is an error."""
    if x.form == "bool":
        return x.column
    n = number(x)
    if x.form == "number":
        return (n != 0) & ~F.isnan(n)
    return F.when(x["dt"] == BOOLEAN, F.coalesce(boolean(x), F.lit(False))).when(is_string(x), F.length(value(x)) > 0).when(is_numeric(x), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))


def of_boolean(x: Column) -> V:
    return V("bool", x)


def of_string(x: Column) -> V:
    return V.of(literal(x))


def of_integer(x: Column) -> V:
    return V("number", x.cast("double"), 1, x.cast("bigint"))


def as_rank(x: Column, by: Column | int) -> V:
    """A double as a literal of the datatype with this rank."""
    return V("number", x if isinstance(by, int) else F.when(by.isNotNull(), x), by)


def same_term(a: V, b: V) -> Column:
    return a.term() == b.term()


def equal(a: V, b: V) -> Column:
    """SPARQL =: by value where datatypes are known, by term otherwise; unknown datatypes that differ are an error."""
    if a.form == b.form == "bool":
        return a.column == b.column
    if a.form == b.form == "number":
        return (a.column == b.column) & ~F.isnan(a.column)
    known = lambda x: is_string(x) | is_numeric(x) | x["dt"].isin(BOOLEAN, DATETIME)
    return (
        F.when(is_numeric(a) & is_numeric(b), (number(a) == number(b)) & ~F.isnan(number(a)))
        .when(same_term(a, b), True)
        .when((a["dt"] == DATETIME) & (b["dt"] == DATETIME), timestamp(a) == timestamp(b))
        .when((a["dt"] == BOOLEAN) & (b["dt"] == BOOLEAN), boolean(a) == boolean(b))
        .when((kind(a) != LITERAL) | (kind(b) != LITERAL) | (known(a) & known(b)), False)
    )


def less(a: V, b: V, or_equal: bool = False) -> Column:
    op = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    numbers = op(number(a), number(b)) & ~F.isnan(number(a)) & ~F.isnan(number(b))
    if "number" in (a.form, b.form) or any(x.fields and x.fields_numeric() for x in (a, b)):
        # One side is a number for sure, so nothing but a number compares.
        return numbers
    return F.when(is_numeric(a) & is_numeric(b), numbers).when((a["dt"] == STRING) & (b["dt"] == STRING), op(value(a), value(b))).when((a["dt"] == DATETIME) & (b["dt"] == DATETIME), op(timestamp(a), timestamp(b))).when((a["dt"] == BOOLEAN) & (b["dt"] == BOOLEAN), op(boolean(a), boolean(b)))


def arithmetic(op: str) -> Callable[[V, V], V]:
    def run(a: V, b: V) -> V:
        by = F.greatest(rank(a), rank(b))
        by = F.when(rank(a).isNotNull() & rank(b).isNotNull(), by)
        x, y = number(a), number(b)
        if op == "/":
            # integer / integer is a decimal; division by zero is an error but for doubles
            real = F.when(y != 0, F.try_divide(x, y)).when(by >= 3, F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan")))
            return as_rank(real, F.greatest(by, F.lit(2)))
        exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](whole(a), whole(b))
        real = {"+": x + y, "-": x - y, "*": x * y}[op]
        return V("number", F.when(by == 1, exact.cast("double")).otherwise(real), by, exact)

    return run


def _unary(f: Callable[[Column], Column]) -> Callable[[V], V]:
    return lambda x: as_rank(f(number(x)), rank(x))


def _like(result: Column, x: V) -> Column:
    """A string with the datatype and language of x, for string x."""
    return F.when(is_string(x), literal(result, x["dt"], x["lang"]))


def _fits(a: V, b: V) -> Column:
    """Argument compatibility: b is simple or has a's language."""
    return is_string(a) & is_string(b) & ((b["lang"] == "") | (a["lang"] == b["lang"]))


def _substr(x: V, start: V, length: V | None = None) -> Column:
    begin = F.floor(number(start) + 0.5)
    end = begin + F.floor(number(length) + 0.5) if length is not None else F.lit(1 << 31).cast("double")
    first = F.greatest(begin, F.lit(1.0))
    return _like(F.substring(value(x), first.cast("int"), F.greatest(F.least(end, F.length(value(x)) + 1.0) - first, F.lit(0.0)).cast("int")), x)


def _before(a: V, b: V) -> Column:
    at = F.position(value(b), value(a))
    return F.when(_fits(a, b), F.when(value(b) == "", _like(F.lit(""), a)).when(at > 0, _like(F.substring(value(a), F.lit(1), at - 1), a)).otherwise(literal("")))


def _after(a: V, b: V) -> Column:
    at = F.position(value(b), value(a))
    return F.when(_fits(a, b), F.when(value(b) == "", a.term()).when(at > 0, _like(F.substring(value(a), at + F.length(value(b)), F.length(value(a))), a)).otherwise(literal("")))


def _encode(x: V) -> Column:
    out = F.url_encode(value(x))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(is_string(x), literal(out))


def _concat(*xs: V) -> Column:
    """The common language survives, else a simple string."""
    if not xs:
        return literal("")
    ok, same = is_string(xs[0]), F.lit(True)
    for x in xs[1:]:
        ok, same = ok & is_string(x), same & (x["lang"] == xs[0]["lang"])
    whole = F.concat(*[value(x) for x in xs])
    return F.when(ok, F.when(same & (xs[0]["lang"] != ""), literal(whole, LANG_STRING, xs[0]["lang"])).otherwise(literal(whole)))


def _flags(pattern: V, flags: V | None) -> Column:
    if flags is None:
        return value(pattern)
    given = F.regexp_replace(value(flags), "[^ismx]", "")
    return F.when(given == "", value(pattern)).otherwise(F.concat(F.lit("(?"), given, F.lit(")"), value(pattern)))


def _regex(x: V, pattern: V, flags: V | None = None) -> V:
    return of_boolean(F.when(is_string(x), F.rlike(value(x), _flags(pattern, flags))))


def _replace(x: V, pattern: V, by: V, flags: V | None = None) -> Column:
    return _like(F.regexp_replace(value(x), _flags(pattern, flags), value(by)), x)


def _lang_matches(tag: V, wanted: V) -> V:
    t, w = F.lower(value(tag)), F.lower(value(wanted))
    return of_boolean(F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))))


def _part(name: str) -> Callable[[V], V]:
    return lambda x: of_integer(F.date_part(F.lit(name), F.when(x["dt"] == DATETIME, _local(x))))


def _local(x: V) -> Column:
    """Local time as written, without its zone."""
    return F.regexp_replace(value(x), r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz")


def _seconds(x: V) -> Column:
    digits = F.regexp_extract(value(x), r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1)
    return F.when((x["dt"] == DATETIME) & (digits != ""), literal(F.regexp_replace(digits, r"^0(?=\d)", ""), DECIMAL))


def _tz(x: V) -> Column:
    return F.when(x["dt"] == DATETIME, literal(F.regexp_extract(value(x), r"(Z|[+-]\d\d:\d\d)$", 1)))


def _timezone(x: V) -> Column:
    zone = F.regexp_extract(value(x), r"(Z|[+-]\d\d:\d\d)$", 1)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    body = F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return F.when((x["dt"] == DATETIME) & (zone != ""), literal(F.when((zone == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").otherwise(body), DURATION))


def _hash(f: Callable[[Column], Column]) -> Callable[[V], Column]:
    return lambda x: F.when(is_string(x), literal(f(value(x).cast("binary"))))


def _cast(dt: str) -> Callable[[V], V | Column]:
    def run(x: V) -> V | Column:
        v, ok = F.trim(value(x)), kind(x) == LITERAL
        if dt == STRING:
            return literal(F.when(kind(x) != BNODE, value(x)))
        if dt == BOOLEAN:
            return of_boolean(F.when(ok, F.when(is_numeric(x), (number(x) != 0) & ~F.isnan(number(x))).when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)))
        if dt == INTEGER:
            digits = F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint"))
            return of_integer(F.when(ok, F.when(x["dt"] == BOOLEAN, boolean(x).cast("bigint")).when(x["dt"].isin(DECIMAL, FLOAT, DOUBLE), F.when(F.abs(number(x)) < 9.0e18, number(x).cast("bigint"))).otherwise(digits)))
        if dt == DATETIME:
            return F.when(ok & F.try_to_timestamp(v).isNotNull() & v.rlike(r"^-?\d{4,}-\d\d-\d\dT"), literal(v, DATETIME))
        n = F.when(x["dt"] == BOOLEAN, boolean(x).cast("double")).when(is_numeric(x), number(x)).when(is_string(x), F.replace(v, F.lit("INF"), F.lit("Infinity")).try_cast("double"))
        n = n.cast("float").cast("double") if dt == FLOAT else n
        return as_rank(F.when(ok, F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n) if dt == DECIMAL else n), {DECIMAL: 2, FLOAT: 3, DOUBLE: 4}[dt])

    return run


def _logic(op: str) -> Callable[[V, V], V]:
    # Three-valued logic of SQL is that of SPARQL, with null for error.
    return lambda a, b: of_boolean(ebv(a) | ebv(b) if op == "||" else ebv(a) & ebv(b))


def _in(x: V, *others: V) -> V:
    out = F.lit(False)
    for o in others:
        out = out | equal(x, o)
    return of_boolean(out)


#: Functions by name; arguments are values, results values or term columns.
FUNCTIONS: dict[str, Callable[..., V | Column]] = {
    "||": _logic("||"), "&&": _logic("&&"), "U!": lambda x: of_boolean(~ebv(x)), "U-": _unary(lambda n: -n),
    "=": lambda a, b: of_boolean(equal(a, b)), "!=": lambda a, b: of_boolean(~equal(a, b)), "<": lambda a, b: of_boolean(less(a, b)), ">": lambda a, b: of_boolean(less(b, a)),
    "<=": lambda a, b: of_boolean(less(a, b, True)), ">=": lambda a, b: of_boolean(less(b, a, True)), "IN": _in, "NOT IN": lambda x, *o: of_boolean(~ebv(_in(x, *o))),
    "+": arithmetic("+"), "-": arithmetic("-"), "*": arithmetic("*"), "/": arithmetic("/"),
    "IF": lambda c, a, b: F.when(ebv(c), a.term()).when(~ebv(c), b.term()), "COALESCE": lambda *xs: F.coalesce(*[x.term() for x in xs]), "SAMETERM": lambda a, b: of_boolean(same_term(a, b)),
    "BOUND": lambda x: of_boolean(x.isNotNull()),
    "ISIRI": lambda x: of_boolean(kind(x) == IRI), "ISURI": lambda x: of_boolean(kind(x) == IRI), "ISBLANK": lambda x: of_boolean(kind(x) == BNODE), "ISLITERAL": lambda x: of_boolean(kind(x) == LITERAL),
    "ISNUMERIC": lambda x: of_boolean(F.when(x.isNotNull(), F.coalesce(number(x).isNotNull(), F.lit(False)))),
    "STR": lambda x: literal(F.when(kind(x) != BNODE, value(x))), "LANG": lambda x: literal(F.when(kind(x) == LITERAL, x["lang"])), "DATATYPE": lambda x: iri(F.when(kind(x) == LITERAL, x["dt"])),
    "IRI": lambda x: iri(F.when((kind(x) == IRI) | (x["dt"] == STRING), value(x))), "URI": lambda x: iri(F.when((kind(x) == IRI) | (x["dt"] == STRING), value(x))),
    "BNODE": lambda *x: term(BNODE, F.concat(F.lit("b"), F.md5(value(x[0]))) if x else F.uuid()), "STRDT": lambda x, dt: literal(F.when(x["dt"] == STRING, value(x)), value(dt)),
    "STRLANG": lambda x, tag: literal(F.when(x["dt"] == STRING, value(x)), LANG_STRING, F.lower(value(tag))), "UUID": lambda: iri(F.concat(F.lit("urn:uuid:"), F.uuid())), "STRUUID": lambda: literal(F.uuid()),
    "STRLEN": lambda x: of_integer(F.when(is_string(x), F.length(value(x)))), "SUBSTR": _substr, "UCASE": lambda x: _like(F.upper(value(x)), x), "LCASE": lambda x: _like(F.lower(value(x)), x),
    "STRSTARTS": lambda a, b: of_boolean(F.when(_fits(a, b), F.startswith(value(a), value(b)))), "STRENDS": lambda a, b: of_boolean(F.when(_fits(a, b), F.endswith(value(a), value(b)))),
    "CONTAINS": lambda a, b: of_boolean(F.when(_fits(a, b), F.contains(value(a), value(b)))), "STRBEFORE": _before, "STRAFTER": _after, "ENCODE_FOR_URI": _encode, "CONCAT": _concat,
    "LANGMATCHES": _lang_matches, "REGEX": _regex, "REPLACE": _replace,
    "ABS": _unary(F.abs), "CEIL": _unary(lambda n: F.ceil(n).cast("double")), "FLOOR": _unary(lambda n: F.floor(n).cast("double")), "ROUND": _unary(lambda n: F.floor(n + 0.5).cast("double")), "RAND": lambda: as_rank(F.rand(), F.lit(4)),
    "NOW": lambda: literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), DATETIME), "YEAR": _part("YEAR"), "MONTH": _part("MONTH"), "DAY": _part("DAY"), "HOURS": _part("HOUR"), "MINUTES": _part("MINUTE"),
    "SECONDS": _seconds, "TZ": _tz, "TIMEZONE": _timezone,
    "MD5": _hash(F.md5), "SHA1": _hash(F.sha1), "SHA256": _hash(lambda b: F.sha2(b, 256)), "SHA384": _hash(lambda b: F.sha2(b, 384)), "SHA512": _hash(lambda b: F.sha2(b, 512)),
    **{XSD + name: _cast(XSD + name) for name in ("string", "boolean", "integer", "decimal", "float", "double", "dateTime")},
}


def register(name: str, f: Callable[..., V | Column]) -> None:
    """An extension function under an IRI; f takes values and returns a value or a term column."""
    FUNCTIONS[name] = f


def call(name: str, args: list[V]) -> V:
    out = FUNCTIONS[name](*args)
    return out if isinstance(out, V) else V.of(out)


def order_key(x: V | Column) -> Column:
    """Sorts unbound, blank nodes, IRIs, literals; numbers and times by value, the rest by text."""
    x = V.of(x) if isinstance(x, Column) else x
    return F.struct(F.coalesce(kind(x), F.lit(0)).alias("k"), number(x).alias("n"), timestamp(x).alias("t"), value(x).alias("v"), x["dt"].alias("d"), x["lang"].alias("l"))

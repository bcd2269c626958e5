"""Link filters: which documents need no visit, by Bloom summaries or by dataset descriptions.

Membership summaries are small tables; a filter is m bits and k positions per value, by double
hashing h1 + i * h2. Two families of h1 and h2: ``md5``, the halves of a 64-bit MD5 prefix, for
filters of this engine; ``fnv``, 32-bit FNV-1a of the value behind an S and behind a W, the one
that published summaries use. Deny rules are prefixes or patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.model import MEM, VOID
from quadloom.plans import algebra as A

#: More rules than this are not broadcast at once.
FEW_RULES = 1000
MEMBERSHIP = ("hashFunction", "sourceCollection", "memberCollection", "binaryRepresentation", "bitSize", "hashSize", "projectedProperty", "projectedResource")


class NoFilterList(ValueError):
    pass


def require(link_filters: list | None) -> list:
    """The context's list of filters; extracting filters without one is an error."""
    if link_filters is None:
        raise NoFilterList("Unable to extract filters without filter output array in context")
    return link_filters


#: Fixed values of FNV-1a with 32 bits, and the two seeds.
FNV_START, FNV_PRIME, FNV_SEEDS = 0x811C9DC5, 0x01000193, (b"S", b"W")


def fnv1a(value: Column, seed: bytes = b"") -> Column:
    """FNV-1a of the seed and then of the UTF-8 bytes, as a bigint."""
    start = FNV_START
    for byte in seed:
        start = (start ^ byte) * FNV_PRIME % (1 << 32)
    digits = F.hex(value.cast("binary"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")
    return F.aggregate(places, F.lit(start).cast("bigint"), lambda h, i: F.pmod(h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME), F.lit(1 << 32)))


def halves(value: Column, family: str = "md5") -> tuple[Column, Column]:
    if family == "fnv":
        return fnv1a(value, FNV_SEEDS[0]), fnv1a(value, FNV_SEEDS[1])
    digest = F.md5(value.cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")


def positions(value: Column, bits: Column, k: Column, family: str = "md5") -> Column:
    h1, h2 = halves(value, family)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.pmod(h1 + i.cast("bigint") * h2, bits.cast("bigint")))


def build(values: DataFrame, key: str, value: str, bits: int, k: int, family: str = "md5") -> DataFrame:
    """One filter per key: the set bit positions, sorted."""
    at = F.explode(positions(F.col(value), F.lit(bits), F.lit(k), family))
    found = values.select(F.col(key), at.alias("at")).groupBy(key).agg(F.sort_array(F.collect_set("at")).alias("positions"))
    return found.select(key, F.lit(bits).alias("bits"), F.lit(k).alias("k"), "positions")


def bitmap_positions(bitmap: Column) -> Column:
    """Set bits of a base64 bitmap, the lowest bit of a byte first; null where it can't be read."""
    raw = F.hex(F.try_to_binary(bitmap, F.lit("base64")))
    byte = lambda i: F.conv(F.substring(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    bits = F.flatten(F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.getbit(byte(i.cast("int")), b) == 1, (8 * i + b).cast("bigint"))), lambda x: x.isNotNull())))
    return F.when(F.length(raw) > 0, bits)


def bitmap(positions_set: Column, bits: Column | int) -> Column:
    """Base64 bitmap of set positions."""
    size = F.ceil((bits if isinstance(bits, Column) else F.lit(bits)) / 8).cast("int")
    one = lambda i: F.aggregate(F.filter(positions_set, lambda p: (p / 8).cast("int") == i), F.lit(0), lambda a, p: a.bitwiseOR(F.pow(F.lit(2), p % 8).cast("int")))
    return F.base64(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(one(i)), 2, "0")), "")))


def contains(positions_set: Column, value: Column, bits: Column, k: Column, family: str = "md5") -> Column:
    return F.forall(positions(value, bits, k, family), lambda p: F.array_contains(positions_set, p))


def holds(raw: Column, value: Column, bits: Column, k: Column, family: str = "md5") -> Column:
    """The same over a binary bitmap, by one byte test per position, however large the filter; a bitmap cut short holds nothing there."""
    byte = lambda p: F.conv(F.hex(F.substring(raw, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.forall(positions(value, bits, k, family), lambda p: F.coalesce(F.getbit(byte(p), (p % 8).cast("int")) == 1, F.lit(False)))


def _last(quads: DataFrame, predicate: str) -> Column:
    """The object met last for a predicate (seq orders arrival)."""
    return F.max_by("o", F.when(F.col("p") == predicate, F.col("seq")))


def membership_summaries(quads: DataFrame) -> DataFrame:
    """Summaries out of metadata quads (s, p, o, seq): the last value of each property wins.

    One row per dataset collection and member filter: dataset, collection, projected_property,
    projected_resource, bits, k, bitmap (base64). Datasets without a filter have nulls there.
    """
    by = quads.filter(F.col("p").isin(*[MEM + m for m in MEMBERSHIP])).groupBy("s").agg(*[_last(quads, MEM + m).alias(m) for m in MEMBERSHIP])
    collections = by.filter("sourceCollection is not null").select(F.col("s").alias("collection"), F.col("sourceCollection").alias("dataset"), F.col("projectedProperty").alias("projected_property"), F.col("projectedResource").alias("projected_resource"))
    functions = by.filter("hashSize is not null").select(F.col("s").alias("hashFunction"), F.col("hashSize").try_cast("int").alias("k"))
    filters = by.filter("memberCollection is not null").select(F.col("memberCollection").alias("collection"), "hashFunction", F.col("bitSize").try_cast("int").alias("bits"), F.col("binaryRepresentation").alias("bitmap")).join(functions, "hashFunction", "left").drop("hashFunction")
    return collections.join(filters, "collection", "left")


def pattern_table(spark, op: A.Op) -> DataFrame:
    """Patterns of a query as rows; null stands for a variable."""
    rows = [tuple(x.value if isinstance(x, A.Term) else None for x in (p.s, p.p, p.o)) for p in A.patterns(op)]
    return spark.createDataFrame(rows, "qs string, qp string, qo string")


def irrelevant_datasets(summaries: DataFrame, patterns: DataFrame, mode: str = "reference", family: str = "md5") -> DataFrame:
    """Distinct datasets that no pattern of the query can match.

    summaries: dataset, projected_property, projected_resource, bits, k, and positions or raw (the
    bitmap as bytes). patterns: see
    pattern_table(); few rows, as a query has. ``reference`` prunes whatever is not shown to be
    relevant: a dataset without a usable filter goes too. ``sound`` prunes only where a filter
    proves that no pattern matches: a property filter against a pattern on that property with a
    bound subject or object that it doesn't hold.
    """
    kept, test = ("raw", holds) if "raw" in summaries.columns else ("positions", contains)
    usable = F.col(kept).isNotNull() & (F.col("bits") > 0) & (F.col("k") > 0)
    has = lambda c: F.col(c).isNotNull() & test(F.col(kept), F.col(c), F.col("bits"), F.col("k"), family)
    free = lambda c: F.col(c).isNull()
    prop, res = F.col("projected_property").isNotNull(), F.col("projected_resource").isNotNull()
    on_property = free("qp") | ((F.col("qp") == F.col("projected_property")) & ((free("qs") & free("qo")) | has("qs") | has("qo")))
    on_resource = (free("qs") & free("qp") & free("qo")) | ((F.col("qs") == F.col("projected_resource")) & (has("qp") | has("qo"))) | ((F.col("qo") == F.col("projected_resource")) & (has("qp") | has("qs")))
    true, no = F.lit(True), F.lit(False)
    if mode == "reference":
        relevant = usable & (F.coalesce(prop & on_property, no) | F.coalesce(res & on_resource, no))
        return summaries.crossJoin(F.broadcast(patterns)).groupBy("dataset").agg(F.bool_or(F.coalesce(relevant, no)).alias("relevant")).filter("not relevant").select("dataset") if _any(patterns) else summaries.select("dataset").distinct()
    proof = usable & prop & (F.col("qp") == F.col("projected_property")) & ((F.col("qs").isNotNull() & ~has("qs")) | (F.col("qo").isNotNull() & ~has("qo")))
    per = summaries.crossJoin(F.broadcast(patterns)).groupBy("dataset", "qs", "qp", "qo").agg(F.bool_or(F.coalesce(proof, no)).alias("proved"))
    return per.groupBy("dataset").agg(F.bool_and(F.coalesce("proved", true)).alias("all")).filter("all").select("dataset")


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


def void_rules(quads: DataFrame) -> DataFrame:
    """Deny rules of datasets that a SPARQL endpoint covers: dataset, prefix, pattern.

    The URI space counts if there is one that isn't empty, else the pattern, else nothing.
    """
    found = quads.groupBy(F.col("s").alias("dataset")).agg(_last(quads, VOID + "sparqlEndpoint").alias("endpoint"), _last(quads, VOID + "uriSpace").alias("space"), _last(quads, VOID + "uriRegexPattern").alias("regex"))
    prefix = F.when(F.col("space") != "", F.col("space"))
    rules = found.filter("endpoint is not null").select("dataset", prefix.alias("prefix"), F.when(prefix.isNull(), F.col("regex")).alias("pattern"))
    return rules.filter("prefix is not null or pattern is not null")


def deny(links: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Links that no rule (prefix or unanchored pattern) covers; links without a URL stay.

    Prefixes are an equi-join on the prefixes of each URL that have a rule's length; patterns, which
    only a nested loop can try, go in blocks of ``FEW_RULES``.
    """
    few = rules.select("prefix", "pattern").distinct()
    prefixes = few.filter("prefix is not null").select(F.col("prefix").alias("__prefix")).distinct()
    lengths = [r[0] for r in prefixes.select(F.length("__prefix")).distinct().collect()]  # no more than a URL has characters
    if lengths:
        parts = links.select(F.col(url).alias("__url")).distinct().select("__url", F.explode(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col("__url"), F.lit(1), n))).alias("__prefix"))
        links = links.join(parts.join(prefixes, "__prefix").select("__url").distinct(), F.col(url) == F.col("__url"), "left_anti")
    blocks = -(-few.filter("pattern is not null").count() // max(FEW_RULES, 1))
    for block in range(blocks):
        some = few.filter(F.col("pattern").isNotNull() & (F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)).select(F.col("pattern").alias("__pattern"))
        links = links.join(some, F.rlike(F.col(url), F.col("__pattern")), "left_anti")
    return links


def deny_prefixes(links: DataFrame, datasets: DataFrame, url: str = "url") -> DataFrame:
    """Links that start with none of the datasets."""
    return deny(links, datasets.select(F.col("dataset").alias("prefix"), F.lit(None).cast("string").alias("pattern")), url)

"""Line deduplication by pairwise alignment of documents that share lines.

Partners of a later document, all of a smaller doc_id:

* all documents that hold a rare line of it, that is a line (trimmed, of ``MIN_CHARS`` characters
  at least) of ``RARE`` holders at most: what two documents have for themselves shows there;
* for a line of more holders, the first of them, so a line in a million documents gives a million
  links, not their square, and no line is too frequent to serve;
* the first document that holds the same two shared lines in a row, so that a block is found whole
  where an early document holds its lines in another order.

Each later document is aligned with each of its partners by patience diff, over all lines of that
length which the two share. Aligned lines are deleted from the later document, and with them the
equal lines of any length that stand next to them in both, so that a whole common block goes. A
document whose lines are all those of an earlier one, in order, is one block and goes whole; it
neither has nor is another partner.

Lines travel as 128-bit hashes with their places; lines that no other document holds, and the
short ones among them, stay behind. Texts move once, to have lines deleted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import column, documents, map_batches, spans, spool

MIN_CHARS = 10
#: All pairs of the holders of a line are aligned up to so many holders; so a line gives 15 pairs at most.
RARE = 6


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers rise."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both.

    Equal heads and tails first; then the longest rising run of lines unique in both, and the
    gaps between them likewise; where no line is unique, equal lines pair up by occurrence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        anchors = _rising([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place])
        if anchors:
            out += anchors
            i0, j0 = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                todo.append((i0, i, j0, j))
                i0, j0 = i + 1, j + 1
            continue
        seen: Counter = Counter()
        numbered = {}
        for j in range(b0, b1):
            numbered[b[j], seen[b[j]]] = j
            seen[b[j]] += 1
        seen.clear()
        pairs = []
        for i in range(a0, a1):
            if (a[i], seen[a[i]]) in numbered:
                pairs.append((i, numbered[a[i], seen[a[i]]]))
            seen[a[i]] += 1
        out += _rising(pairs)
    return sorted(out)


#: A line on its way: its hash, its place in the text, and whether it is long enough to find partners.
LINE = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("place", "<i4"), ("long", "?")])


def sequences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, lines (LINE records as bytes, short and empty lines too) and the whole text's hash, of the documents with a line of min_chars."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        out, owners, texts = [], [], []
        for text, doc in zip(column(batch, "text"), batch.column(0).to_pylist(), strict=True):
            lines = [line.strip() for line in text.split(b"\n")]
            long = [len(line) >= min_chars and len(line.decode()) >= min_chars for line in lines]
            if any(long):
                made = np.empty(len(lines), LINE)
                hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)
                made["hi"], made["lo"], made["place"], made["long"] = hashes[:, 0], hashes[:, 1], np.arange(len(lines)), long
                out.append(made.tobytes())
                owners.append(doc)
                texts.append(xxhash.xxh3_128_digest(b"\n".join([b"", *lines])))  # no line holds a line break
        whole = np.frombuffer(b"".join(texts), "<i8").reshape(-1, 2)
        return {"doc_id": owners, "lines": out, "hi": whole[:, 0], "lo": whole[:, 1]}

    return map_batches(docs, per_batch, "doc_id long, lines binary, hi long, lo long")


def line_places(sequences: DataFrame) -> DataFrame:
    """Distinct long lines of each document: hi, lo (128 bits), doc_id and the places of the line (array)."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        keys, owners, places = [], [], []
        for lines, doc in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            made = np.frombuffer(lines, LINE)
            found: dict[tuple[int, int], list[int]] = {}
            for hi, lo, place, _ in made[made["long"]].tolist():
                found.setdefault((hi, lo), []).append(place)
            keys += found
            owners += [doc] * len(found)
            places += found.values()
        hashes = np.array(keys, np.int64).reshape(-1, 2)
        flat = np.fromiter((i for p in places for i in p), np.int32)
        lists = pa.ListArray.from_arrays(pa.array(spans(np.fromiter(map(len, places), np.int64, len(places))), pa.int32()), pa.array(flat))
        return {"hi": hashes[:, 0], "lo": hashes[:, 1], "doc_id": owners, "places": lists}

    return map_batches(sequences, per_batch, "hi long, lo long, doc_id long, places array<int>")


def _blocks(lines: bytes, shared: list[int]) -> bytes:
    """The lines at the shared places, and the short lines that only short or shared lines part from them."""
    made = np.frombuffer(lines, LINE)
    held = np.zeros(len(made), bool)
    held[shared] = True
    run = np.cumsum(made["long"] & ~held)
    return made[(held | ~made["long"]) & (np.bincount(run[held], minlength=run[-1] + 1) > 0)[run]].tobytes()


def aligned(theirs: np.ndarray, mine: np.ndarray) -> list[int]:
    """Places in mine of the common blocks: long lines by patience diff, and equal lines next to them in both texts."""
    a, b = list(zip(theirs["hi"].tolist(), theirs["lo"].tolist(), strict=True)), list(zip(mine["hi"].tolist(), mine["lo"].tolist(), strict=True))
    both = set(a).intersection(b)
    at_a = [i for i, (x, long) in enumerate(zip(a, theirs["long"].tolist(), strict=True)) if long and x in both]
    at_b = [j for j, (x, long) in enumerate(zip(b, mine["long"].tolist(), strict=True)) if long and x in both]
    pairs = [(at_a[i], at_b[j]) for i, j in patience([a[i] for i in at_a], [b[j] for j in at_b])]
    in_a, in_b = theirs["place"].tolist(), mine["place"].tolist()
    out = [j for _, j in pairs]
    for (i0, j0), (i1, j1) in zip([(-1, -1), *pairs], [*pairs, (len(a), len(b))], strict=True):
        i, j = i0 + 1, j0 + 1
        while j0 >= 0 and i < i1 and j < j1 and a[i] == b[j] and in_a[i] == in_a[i - 1] + 1 and in_b[j] == in_b[j - 1] + 1:
            out.append(j)
            i, j = i + 1, j + 1
        p, q = i1 - 1, j1 - 1
        while j1 < len(b) and p >= i and q >= j and a[p] == b[q] and in_a[p] == in_a[p + 1] - 1 and in_b[q] == in_b[q + 1] - 1:
            out.append(q)
            p, q = p - 1, q - 1
    return [in_b[j] for j in out]


def neighbours(blocks: DataFrame) -> DataFrame:
    """Distinct pairs of shared long lines that follow each other in a document, lines left out that no other shares: hi, lo (128 bits), doc_id."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        digests, owners = [], []
        for lines, doc in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
            made = np.frombuffer(lines, LINE)
            keys = np.ascontiguousarray(np.stack([made["hi"][made["long"]], made["lo"][made["long"]]], 1)).tobytes()
            found = {xxhash.xxh3_128_digest(keys[i : i + 32]) for i in range(0, len(keys) - 16, 16)}
            digests += found
            owners += [doc] * len(found)
        hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return {"hi": hashes[:, 0], "lo": hashes[:, 1], "doc_id": owners}

    return map_batches(blocks, per_batch, "hi long, lo long, doc_id long")


def _flags(places: list[list[int]]) -> list[bool]:
    """Flags of the deleted lines, up to the last of them."""
    gone = {j for some in places for j in some}
    flags = [False] * (max(gone) + 1 if gone else 0)
    for j in gone:
        flags[j] = True
    return flags


def _firsts(keys: DataFrame, name: str) -> DataFrame:
    """hi, lo, the first of at least two documents that hold them and their number, written before it is joined back, so that Spark can split a key that very many documents hold."""
    held = keys.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    return spool(held.filter("first < last").select("hi", "lo", "first", "n"), name)


def rare_pairs(shared: DataFrame, rare: int = RARE) -> DataFrame:
    """doc_id and first: each two holders of a line of at most ``rare`` holders; sets of holders that many lines share count once."""
    sets = shared.filter(F.col("n") <= rare).groupBy("hi", "lo").agg(F.sort_array(F.collect_set("doc_id")).alias("docs")).select("docs").distinct()
    each = sets.select("docs", F.posexplode("docs").alias("at", "doc_id"))
    return each.select("doc_id", F.explode(F.slice("docs", F.lit(1), F.col("at"))).alias("first"))


def deleted_lines(docs: DataFrame, min_chars: int = MIN_CHARS, rare: int = RARE) -> DataFrame:
    """doc_id and gone (array of flags, up to the last deleted line) of documents that lose lines."""
    every = spool(sequences(docs, min_chars), "sequences")
    copies = spool(every.join(_firsts(every.select("hi", "lo", "doc_id"), "first-texts"), ["hi", "lo"]).filter("doc_id > first").select("hi", "lo", "doc_id", (F.octet_length("lines") / LINE.itemsize).cast("int").alias("size")), "copies")
    whole = every.join(copies.select("hi", "lo", "doc_id"), ["hi", "lo", "doc_id"], "left_anti")
    lines = spool(line_places(whole.select("doc_id", "lines")), "lines")
    shared = spool(lines.join(_firsts(lines, "first-lines"), ["hi", "lo"]).select("hi", "lo", "doc_id", "first", "n", "places"), "shared-lines")
    held = shared.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("shared"))
    blocks = spool(map_batches(whole.select("doc_id", "lines").join(held, "doc_id"), lambda batch: {"doc_id": batch.column(0), "lines": list(map(_blocks, batch.column(1).to_pylist(), batch.column(2).to_pylist()))}, "doc_id long, lines binary"), "blocks")
    rows = spool(neighbours(blocks), "neighbours")
    linked = shared.filter(F.col("n") > rare).select("doc_id", "first").unionByName(rows.join(_firsts(rows, "first-neighbours"), ["hi", "lo"]).select("doc_id", "first"))
    pairs = spool(linked.filter("doc_id > first").unionByName(rare_pairs(shared, rare)).distinct(), "pairs")
    theirs = pairs.join(blocks.select(F.col("doc_id").alias("first"), F.col("lines").alias("theirs")), "first").select("doc_id", "theirs")

    def per_batch(batch: pa.RecordBatch) -> dict:
        rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        return {"doc_id": batch.column(0), "places": [aligned(np.frombuffer(a, LINE), np.frombuffer(b, LINE)) for a, b in rows]}

    places = map_batches(theirs.join(blocks, "doc_id").select("doc_id", "theirs", "lines"), per_batch, "doc_id long, places array<int>")
    places = places.unionByName(copies.select("doc_id", F.sequence(F.lit(0), F.col("size") - 1).alias("places")))
    gone = places.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    return map_batches(gone, lambda batch: {"doc_id": batch.column(0), "gone": list(map(_flags, batch.column(1).to_pylist()))}, "doc_id long, gone array<boolean>")


def remove_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of docs with text without its deleted lines, and n_lines and n_removed.

    A null text stays null and has 0 lines. Lines inside one document are no duplicates of each
    other. Rows with a null doc_id stay untouched; rows that share a doc_id lose the lines found
    in any of them. A table may have any other columns but n_lines and n_removed, which are
    replaced. An empty table gives no rows.
    """
    gone = deleted_lines(documents(docs).filter("doc_id is not null and text is not null"), min_chars).select(F.col("doc_id").alias("__doc"), F.col("gone").alias("__gone"))
    kept = F.filter(F.zip_with(F.split("text", "\n"), "__gone", lambda x, g: F.struct(x.alias("x"), g.alias("g"))), lambda s: s["x"].isNotNull() & ~F.coalesce(s["g"], F.lit(False)))
    rest = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    removed = F.coalesce(F.size(F.filter("__gone", lambda g: g)), F.lit(0))
    out = docs.join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(
        *[F.when(F.col("__gone").isNotNull(), rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNotNull(), removed).otherwise(0).cast("long").alias("n_removed"),
    )

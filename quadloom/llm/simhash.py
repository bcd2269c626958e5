"""Near duplicates by 64-bit SimHash, linked through BK-trees.

1. Fingerprints: XXH64 of 3-word shingles, majority of each bit.
2. Distinct fingerprints are dealt to shards: the 64 bits are cut into radius + 1 blocks, and two
   fingerprints within the radius agree in one block at least, so each block's value names a
   shard and no link is lost. A shard of over ``TREE_NODES`` fingerprints is cut again in the same
   way by the bits that its members may still differ in, until every shard is one tree of bounded
   size: n members of a shared block give 3 n rows a turn, at most six turns, never n * n.
3. A task builds the BK-trees of its shards (children keyed by Hamming distance to the parent)
   and follows, for each member, only the edges within distance +- radius. A tree reaches its
   queries through the shuffle, not through a broadcast: the trees of all shards together grow
   with the corpus, so no bound on a broadcast could be proven.
4. Links shrink to spanning trees inside each shard; components() joins the shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import column, documents, map_batches, spans, spool, tidy, tune, words
from quadloom.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
TREE_NODES = 4096
#: Members of whole shards that a task holds together, and queries that it searches at once: where all members of a
#: tree are alike each query visits every node, so memory follows QUERIES * TREE_NODES.
TOGETHER, QUERIES = 1 << 16, 1 << 9
#: Bytes of a text that are split into words at once, and hashes whose bits are counted at once: each hash needs 64
#: bytes and more for that, so memory follows these and not the length of a text.
PIECE, HASHES = 1 << 18, 1 << 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, those of about PIECE bytes at a time."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)
        end = blank.start() if blank else len(text)
        yield words(text[at:end].lower())
        at = end


def fingerprint_batch(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_digest
    counts, ones = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    owners, sizes, parts, held = [], [], [], 0

    def settle() -> None:
        nonlocal held
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8)).reshape(-1, 64)
        np.add.at(ones, owners, np.add.reduceat(bits, spans(np.array(sizes))[:-1], axis=0, dtype=np.int32))
        for settled in (owners, sizes, parts):
            settled.clear()
        held = 0

    def add(text: int, hashes: list[bytes]) -> None:
        nonlocal held
        counts[text] += len(hashes)
        owners.append(text)
        sizes.append(len(hashes))
        parts.append(b"".join(hashes))
        held += len(hashes)
        if held >= HASHES:
            settle()

    for i, text in enumerate(texts):
        # The last words of a piece, with which the next one's first shingles begin.
        split: list[bytes] = []
        for more in _pieces(text):
            split += more
            if len(split) >= shingle:
                # Shingles are slices of the words joined by single spaces.
                joined = b" ".join(split)
                at = [0, *np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1).tolist()]
                add(i, [digest(joined[a : b - 1], seed) for a, b in zip(at, at[shingle:], strict=False)])
                split = split[len(split) - shingle + 1 :]
        if split and not counts[i]:
            add(i, [digest(b" ".join(split), seed)])
    if parts:
        settle()
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long); a null text has no words, so fp is zero."""
    return map_batches(documents(docs), lambda batch: {"doc_id": batch.column(0), "fp": fingerprint_batch(column(batch, "text"), shingle, seed).view(np.int64)}, "doc_id long, fp long")


class Forest:
    """BK-trees over many shards at once, built and searched level by level."""

    def __init__(self, points: np.ndarray, tree: np.ndarray) -> None:
        """points: uint64; tree: number of each point's tree, ascending. The first point of a tree is its root."""
        self.points = points
        n = len(points)
        roots = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if n else np.empty(0, np.int64)
        self.root = {int(t): int(r) for t, r in zip(tree[roots], roots, strict=True)}
        moving = np.setdiff1d(np.arange(n), roots, assume_unique=True)
        parent = np.repeat(roots, np.diff(np.append(roots, n)))[moving] if n else moving
        keys, children = [], []
        while len(moving):
            # The first to come to a free edge becomes its child; the others go on below it.
            edge = parent * 65 + np.bitwise_count(points[moving] ^ points[parent])
            edges, first, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(moving[first])
            parent = moving[first][back]
            stay = np.ones(len(moving), bool)
            stay[first] = False
            moving, parent = moving[stay], parent[stay]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.children = self.keys[order], np.concatenate(children)[order] if children else np.empty(0, np.int64)

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, point number) within the radius, looking into one tree for each query."""
        which, node = np.arange(len(queries)), roots
        found_q, found_p = [], []
        while len(which):
            distance = np.bitwise_count(queries[which] ^ self.points[node]).astype(np.int64)
            near = distance <= radius
            found_q.append(which[near])
            found_p.append(node[near])
            next_q, next_n = [], []
            if len(self.keys):
                for step in range(-radius, radius + 1):
                    key = np.where(distance + step >= 0, node * 65 + distance + step, -1)
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[at] == key
                    next_q.append(which[hit])
                    next_n.append(self.children[at[hit]])
            which, node = (np.concatenate(next_q), np.concatenate(next_n)) if next_q else (which[:0], node[:0])
        return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else (which, node)


def _least(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (numbers of points) lowered along the links until they stand."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def shard_links(fps: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole shards (numbers, ascending): each shard is one tree, and all its members query it."""
    forest = Forest(fps, shard)
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    roots = np.repeat(first, np.diff(np.append(first, len(shard))))
    points, back = np.unique(fps, return_inverse=True)
    labels = np.arange(len(points))
    for i in range(0, len(fps), QUERIES):
        q, p = forest.search(fps[i : i + QUERIES], roots[i : i + QUERIES], radius)
        a, b = back[i + q], back[p]
        if (different := a != b).any():
            labels = _least(labels, a[different], b[different])
    moved = np.flatnonzero(labels != np.arange(len(points)))
    return points[moved], points[labels[moved]]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp) come sorted by shard; a shard's rows are never divided."""
    held: list[np.ndarray] = []
    n = 0

    def settle(rows: np.ndarray) -> pa.RecordBatch:
        shard = np.cumsum((np.diff(rows[0], prepend=rows[0][:1]) != 0) | (np.diff(rows[1], prepend=rows[1][:1]) != 0))
        a, b = shard_links(rows[2].view(np.uint64), shard, radius)
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
        n += batch.num_rows
        if n >= TOGETHER:
            rows = np.concatenate(held, axis=1)
            other = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
            upto = int(other[-1]) + 1 if len(other) else 0
            if upto:
                yield settle(np.ascontiguousarray(rows[:, :upto]))
            held, n = [rows[:, upto:]], rows.shape[1] - upto
    if n:
        yield settle(np.concatenate(held, axis=1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int, radius: int) -> list[int]:
    """A mask of agreed bits with each of radius + 1 parts of the other bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = radius + 1
    return [mask | sum(1 << b for b in free[len(free) * i // parts : len(free) * (i + 1) // parts]) for i in range(parts)]


def links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints fp at ``radius`` or fewer differing bits."""
    tune(distinct.sparkSession)
    masks, rows = [0], distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    out = None
    while masks:
        cut = {m: finer(m, radius) for m in masks}
        table = F.create_map(*[x for m, new in cut.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in new]))])
        shards = rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        # Written before they are joined back, so that Spark can split a shard that very many share.
        sizes = spool(shards.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
        # So few open bits that all members are within the radius, or as good as none, need no finer cut.
        masks = sorted({k for new in cut.values() for k in new if 64 - k.bit_count() > radius})
        hot = F.col("n") > tree_nodes
        if masks:
            hot = hot & F.col("mask").isin(*map(_signed, masks))
        found = shards.join(sizes.filter(~hot if masks else F.lit(True)).select("mask", "value"), ["mask", "value"]).select("mask", "value", "fp")
        some = found.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(tidy(lambda it: _search(it, radius)), "a long, b long")
        out = some if out is None else out.unionByName(some)
        if not masks or (larger := sizes.filter(hot)).isEmpty():
            return out
        masks = sorted(m & (1 << 64) - 1 for (m,) in larger.select("mask").distinct().collect())  # 3 ** turn at most
        rows = spool(shards.join(larger.select("mask", "value"), ["mask", "value"]).select("fp", "mask"), "hot-shards")
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, fingerprint_table: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id of its class).

    Texts that are null, empty or only white space have fingerprint zero and link like any other.
    Repeated rows of a doc_id stay; rows with a null doc_id keep a row but never name a class
    (component_id is null if no member has a doc_id). An empty table gives no rows.
    """
    prints = spool(fingerprint_table if fingerprint_table is not None else fingerprints(docs, shingle, seed), "fingerprints")
    distinct = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    classes = spool(distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    named = spool(classes.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return prints.join(classes.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")

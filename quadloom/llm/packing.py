"""Order-preserving packing of token streams into sequences, by dynamic programming.

Documents stay in ascending doc_id order; only window cuts are chosen. A cut may stand behind a
document (free), behind a sentence (``SENTENCE_PENALTY``) or, where neither comes for
``HARD_GAP`` tokens, inside text (``HARD_PENALTY``). With boundary positions c,

    cost[j] = penalty[j] + min over c[j] - c[i] <= size of cost[i] + padding(c[j] - c[i])

where padding is size - length, or 0 if the length is a power of two. The first form depends on i
only through cost[i] + c[i], so a monotone queue gives each minimum in constant time; the powers
of two, from 1 to below size, are direct look-ups.

A task settles its documents in blocks of at least ``BLOCK_TOKENS`` tokens: the cuts of a block are
the best for the block, and its last two sequences, which the block's end bends, are cut anew
with the next one. So cuts are the best possible up to two sequences a block.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.bpe import default_path, word_ids
from quadloom.llm.common import documents, regrouped, spans, tidy, tune

SIZE, END_ID = 2048, 1
#: Costs in padded tokens.
SENTENCE_PENALTY, HARD_PENALTY, HARD_GAP = 4, 64, 128
#: Tokens that a task holds, at least, before it settles all but the last two sequences of them.
BLOCK_TOKENS = 1 << 19


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may stand, from 0 to the end, and the penalty of each."""
    gap = min(HARD_GAP, size)
    at = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    extra = (np.diff(at) - 1) // gap
    wide = np.flatnonzero(extra)
    if len(wide):
        n = extra[wide]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        at = np.union1d(at, np.repeat(at[wide], n) + gap * step)
    penalty = np.full(len(at), HARD_PENALTY, np.int64)
    penalty[np.isin(at, sentence_ends, assume_unique=False)] = SENTENCE_PENALTY
    penalty[np.isin(at, doc_ends)] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Positions of an optimal cut sequence, 0 and the last position included."""
    c, pen = at.tolist(), penalty.tolist()
    index = np.full(c[-1] + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    jumps = [np.where(at >= p, index[np.maximum(at - p, 0)], -1).tolist() for p in powers]
    cost, back, value = [0] * len(c), [0] * len(c), [0] * len(c)
    queue: deque[int] = deque([0])
    for j in range(1, len(c)):
        here, low = c[j], c[j] - size
        while c[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = value[i] + size - here
        for jump in jumps:
            k = jump[j]
            if k >= 0 and cost[k] < best:
                best, i = cost[k], k
        best += pen[j]
        cost[j], back[j] = best, i
        value[j] = now = best + here
        while queue and value[queue[-1]] >= now:
            queue.pop()
        queue.append(j)
    cuts = [len(c) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [c[i] for i in reversed(cuts)]


def split_tail(cuts: list[int], size: int = SIZE) -> list[int]:
    """A short last sequence goes to powers of two, without padding, where that costs less."""
    length = cuts[-1] - cuts[-2] if len(cuts) > 1 else 0
    if length & (length - 1) and (length.bit_count() - 1) * HARD_PENALTY < size - length:
        at, tail = cuts[-2], []
        for bit in range(length.bit_length() - 1, -1, -1):
            if length >> bit & 1:
                tail.append(at := at + (1 << bit))
        return cuts[:-1] + tail
    return cuts


class _Buffer:
    """Tokens of consecutive documents that are not in a settled sequence yet."""

    def __init__(self, size: int) -> None:
        self.size, self.sequences = size, 0
        self.ids, self.ends = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.docs, self.starts, self.totals, self.lengths = (np.empty(0, np.int64) for _ in range(4))

    def add(self, ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs, self.starts = np.concatenate([self.docs, docs]), np.concatenate([self.starts, np.zeros(len(docs), np.int64)])
        self.totals, self.lengths = np.concatenate([self.totals, lengths]), np.concatenate([self.lengths, lengths])

    def settle(self, last: bool) -> dict:
        offsets = spans(self.lengths)
        cuts = best_cuts(*boundaries(offsets[1:], self.ends, self.size), self.size)
        cuts = np.array(split_tail(cuts, self.size) if last else cuts[:-2] if len(cuts) > 3 else cuts[:1])
        upto = int(cuts[-1])
        piece = np.unique(np.concatenate([cuts, offsets[offsets < upto]]))
        begin, length = piece[:-1], np.diff(piece)
        doc, seq = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(cuts, begin, "right") - 1
        out = {"doc_id": self.docs[doc], "start": self.starts[doc] + begin - offsets[doc], "length": length, "doc_tokens": self.totals[doc], "sequence": self.sequences + seq, "offset": begin - cuts[seq], "at": begin, "ids": self.ids[:upto]}
        self.sequences += len(cuts) - 1
        rest = int(np.searchsorted(offsets, upto, "right")) - 1
        self.ids, self.ends = self.ids[upto:], self.ends[self.ends > upto] - upto
        self.docs, self.totals = self.docs[rest:], self.totals[rest:]
        cut = upto - offsets[rest] if rest < len(self.lengths) else 0
        self.starts, self.lengths = self.starts[rest:].copy(), self.lengths[rest:].copy()
        if len(self.starts):
            self.starts[0] += cut
            self.lengths[0] -= cut
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 40
    buffer = _Buffer(size)

    def rows(out: dict) -> pa.RecordBatch:
        raw = memoryview(out["ids"].astype("<u4").tobytes())
        crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(out["at"].tolist(), out["length"].tolist(), strict=True)]
        made = [pa.array(x, pa.int64()) for x in (out["doc_id"], out["start"], out["length"], crcs, out["doc_tokens"], first + out["sequence"], out["offset"])]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            made.append(pa.ListArray.from_arrays(pa.array(spans(out["length"]), pa.int32()), pa.array(out["ids"].astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(made, names=names)

    for batch in regrouped(batches):
        if not batch.num_rows:
            continue
        ids, offsets, ends = word_ids(path).encode(batch.column(1))
        # Each document's end id moves what follows it by one.
        moved = ends + np.searchsorted(offsets[1:], ends, "left")
        buffer.add(np.insert(ids, offsets[1:], end_id), moved, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets) + 1)
        if len(buffer.ids) >= BLOCK_TOKENS:
            yield rows(buffer.settle(last=False))
    if len(buffer.ids):
        yield rows(buffer.settle(last=True))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` tokens.

    A null text counts as empty: its only token is the end id. Rows with a null doc_id are not
    documents and are left out; a repeated doc_id gives that many documents, ordered by text.
    An empty table gives no rows. Sequences never reach over a partition of the doc_id ranges;
    each partition's last one is cut to powers of two where padding would cost more.
    sequence_id is partition * 2**40 + number.
    """
    file = tokenizer or default_path()
    tune(docs.sparkSession)
    ordered = documents(docs).filter("doc_id is not null").withColumn("text", F.coalesce("text", F.lit(""))).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidy(lambda it: _pack(it, file, end_id, size, with_ids)), SCHEMA + (", ids array<int>" if with_ids else ""))

"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length word window.

A word goes if a window over it (``WINDOW`` consecutive words of one document) has the same word
sequence as a window of a document with a smaller doc_id. Windows are judged on the input.

Shuffling a hash for every word of the corpus would cost many times its size, so the search has
two exact steps. Among the 31 stretches of 20 words in a window, the one with the smallest hash
is picked (its minimizer); equal windows have equal minimizers, and neighbouring windows mostly
share theirs. So (1) documents exchange only their distinct minimizers; one that no other
document has proves its windows unrepeated. (2) Only windows with a shared minimizer send their
own Rabin-Karp hash, position and document, and Spark finds each hash's smallest document.
Exact copies of a whole text are known beforehand: each later one loses every window, and only
the first takes part in the search.

Hashes are 64 bits of word hashes of 64 bits (XXH64), and windows are joined by their own hash and
their minimizer together: two different windows are confused only if both collide at once.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import column, documents, map_batches, spans, spool, words

WINDOW, ANCHOR = 50, 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word of all texts in a row, and the offsets of the texts."""
    digest = xxhash.xxh64_digest
    split = [words(t) for t in texts]
    hashes = b"".join([digest(w) for ws in split for w in ws])
    return np.frombuffer(hashes, "<u8"), spans(np.fromiter(map(len, split), np.int64, len(split)))


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash sum h[i + k] * BASE**(length - 1 - k) of each window, modulo 2**64.

    Built by doubling: a window of a + b words is that of a, times BASE**b, plus that of b.
    """
    done, size, power, at = None, 0, hashes, 1
    factor = BASE
    while True:
        if length & at:
            if done is None:
                done, size, own = power, at, factor
            else:
                n = len(hashes) - size - at + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                done, size, own = power[:n] * own + done[at : at + n], size + at, own * factor
        if at * 2 > length:
            return done
        n = len(power) - at
        if n <= 0:
            return np.empty(0, np.uint64)
        power = power[:n] * factor + power[at : at + n]
        factor = factor * factor
        at *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, now = 1, values
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window inside one text: its text, start (in all words), hash and minimizer."""
    if len(hashes) < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    with np.errstate(over="ignore"):
        whole = rolling(hashes, window)
        least = rolling(hashes, anchor)
        least = (least ^ least >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        least = sliding_min(least ^ least >> np.uint64(32), window - anchor + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(text[: len(whole)] == text[window - 1 :])
    return text[start], start, whole[start], least[start]


def minimizers(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of at least one window: doc_id and its distinct minimizers (array)."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        text, _, _, least = window_hashes(*word_hashes(column(batch, "text")), window=window)
        run = np.ones(len(text), bool)
        run[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
        text, least = text[run], least[run]
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        each = [np.unique(least[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[np.diff(bounds) > 0]
        flat = np.concatenate(each) if each else np.empty(0, np.int64)
        return {"doc_id": ids, "leasts": pa.ListArray.from_arrays(pa.array(spans(np.array(list(map(len, each)), np.int64)), pa.int32()), pa.array(flat))}

    return map_batches(docs, per_batch, "doc_id long, leasts array<long>")


def _shared_windows(batch: pa.RecordBatch, window: int) -> dict:
    hashes, offsets = word_hashes(column(batch, "text"))
    text, start, whole, least = window_hashes(hashes, offsets, window)
    lists = batch.column(batch.schema.get_field_index("shared"))
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), spans(np.asarray(lists.value_lengths().fill_null(0)))
    keep = np.zeros(len(text), bool)
    low, high = np.searchsorted(text, np.arange(batch.num_rows)), np.searchsorted(text, np.arange(batch.num_rows), "right")
    for i in range(batch.num_rows):
        keep[low[i] : high[i]] = np.isin(least[low[i] : high[i]], flat[at[i] : at[i + 1]])
    text, start, whole, least = text[keep], start[keep], whole[keep], least[keep]
    return {"hash": whole.view(np.int64), "least": least.view(np.int64), "doc_id": batch.column(0).to_numpy(zero_copy_only=False)[text], "at": start - offsets[text]}


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) that windows at these starts cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    new = np.concatenate([[True], np.diff(starts) > window])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), (starts[last] + window).tolist(), strict=True))


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id of every document whose whole text is that of a smaller doc_id (by 128 hash bits)."""
    prints = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    firsts = spool(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"), "first-copies")
    return prints.join(firsts, ["h1", "h2"]).filter("doc_id > first").select("doc_id").distinct()


def repeated_windows(docs: DataFrame, copies: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the starts (array) of its windows that also start in a smaller doc_id.

    docs: doc_id (not null) and text; copies, from later_copies(), neither ask nor answer.
    """
    marks = spool(minimizers(docs, window).join(copies, "doc_id", "left_anti"), "minimizers").select("doc_id", F.explode("leasts").alias("least"))
    # Aggregates are written before they are joined back: between two plain shuffles Spark splits a
    # key that very many documents share, below an aggregate it couldn't.
    shared = spool(marks.groupBy("least").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("least"), "shared-minimizers")
    lists = spool(marks.join(shared, "least").groupBy("doc_id").agg(F.collect_list("least").alias("shared")), "shared")
    found = spool(map_batches(docs.join(lists, "doc_id"), lambda batch: _shared_windows(batch, window), "hash long, least long, doc_id long, at int"), "windows")
    first = spool(found.groupBy("hash", "least").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("hash", "least", "first"), "first-windows")
    return found.join(first, ["hash", "least"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_list("at").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removed (maximal intervals of word numbers), kept (text).

    kept joins the words that stay by one space. A null text counts as having no words; texts of
    fewer words than a window lose nothing. Rows with a null doc_id are left out; an empty table
    gives no rows. doc_id must not repeat: rows that share one are told apart from no other row,
    so each loses the windows found in any of them.
    """
    base = documents(docs).filter("doc_id is not null")
    copies = spool(later_copies(base), "copies")
    gone = repeated_windows(base, copies, window).select("doc_id", "starts", F.lit(False).alias("whole"))
    gone = gone.unionByName(copies.select("doc_id", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))

    def per_batch(batch: pa.RecordBatch) -> dict:
        texts, lists, whole = column(batch, "text"), batch.column(batch.schema.get_field_index("starts")), batch.column(batch.schema.get_field_index("whole")).to_pylist()
        n_words, n_removed, removed, kept = [], [], [], []
        for i, text in enumerate(texts):
            split = words(text)
            if whole[i]:
                gone = [(0, len(split))] if len(split) >= window else []
            else:
                gone = [(a, b) for a, b in merged(np.asarray(lists[i].values), window) if b <= len(split)] if lists[i].is_valid else []
            stay, at = [], 0
            for a, b in gone:
                stay += split[at:a]
                at = b
            stay += split[at:]
            n_words.append(len(split))
            n_removed.append(len(split) - len(stay))
            removed.append([{"from": a, "to": b} for a, b in gone])
            kept.append(b" ".join(stay))
        return {"doc_id": batch.column(0), "n_words": n_words, "n_removed": n_removed, "removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    return map_batches(base.join(gone, "doc_id", "left"), per_batch, "doc_id long, n_words long, n_removed long, removed array<struct<from: long, to: long>>, kept string")


def digest(removed: DataFrame) -> DataFrame:
    """The kept text as its SHA-256."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["digest", "later_copies", "merged", "minimizers", "remove_repeats", "repeated_windows", "rolling", "sliding_min", "window_hashes", "word_hashes"]

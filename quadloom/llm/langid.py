"""Language identification by bit-sliced Bloom filters over byte n-grams.

One filter serves all languages: row p of the table holds a bit for each language, and adding an
n-gram to a language sets that language's bit in k rows. ANDing the k rows of an n-gram returns
all languages that contain it. A text is decided by the languages' popcounts over its n-grams,
each corrected for its slice's false positives: a slice with fill f answers yes by chance with
probability f**k, so (count - n * f**k) / (1 - f**k) of n n-grams count. The part of a text's
n-grams that the best language knows, so corrected, tells texts of an unlearned language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import column, documents, map_batches, spool, tidy, tune

ORDERS = (3, 5)
HASHES = 3
#: Bound of the model: n-grams, each language's equal part of them, the most frequent (with all of the same count) first.
MAX_GRAMS = 400_000
#: Different n-grams that a task counts together before it hands them on.
HELD_GRAMS = 1 << 20
#: A language contains an n-gram seen so often in it, at this part at least of its best language's rate.
LEAST_COUNT, LEAST_SHARE = 3, 0.25
#: Rows of the filter for each n-gram of the language that has most: slices are filled to a third at most.
ROWS_PER_GRAM = 8
#: The part of what is known of a language's own held-out texts that a text must reach to be of the language; and the
#: steps between 0 and 1 in which the median over those texts is taken.
CUT, CUT_STEPS = 0.5, 10_000
UNKNOWN = "und"
_BLANK = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of lower-cased texts (all but letters blank, edges padded) and the text of each."""
    padded = [b" " + t.decode().lower().encode().translate(_BLANK) + b" " for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))
    n = len(data) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.full(n, order, np.uint64)
    for i in range(order):
        key <<= np.uint64(8)
        key |= data[i : i + n]
    whole = owner[:n] == owner[order - 1 :]
    return key[whole], owner[:n][whole]


def has_letter(text: bytes) -> bool:
    """A character of the Unicode categories L*; numbers such as U+00BD or U+2160 are none."""
    return any(map(str.isalpha, text.decode()))


class Filters:
    """table: (rows, words of 64 languages)."""

    def __init__(self, languages: list[str], rows: int) -> None:
        self.languages = languages
        self.table = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        return [((keys ^ keys >> np.uint64(31)) * m >> np.uint64(40)) & mask for m in _MIX[:HASHES]]

    def add(self, keys: np.ndarray, language: int) -> None:
        for at in self._places(keys):
            self.table[at, language // 64] |= np.uint64(1 << language % 64)

    def finish(self) -> None:
        fill = np.array([(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.chance = fill**HASHES

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """Bits of all languages that contain each n-gram."""
        first, *others = self._places(keys)
        found = self.table[first]
        for at in others:
            found = found & self.table[at]
        return found

    def decide(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, score best / (best + second), 0 where no n-gram is known, and the part of the n-grams that it knows."""
        n = len(texts)
        yes, asked = np.zeros((n, len(self.languages))), np.zeros(n)
        for order in ORDERS:
            keys, owner = grams(texts, order)
            found = self.languages_of(keys)
            asked += np.bincount(owner, minlength=n)
            for i in range(len(self.languages)):
                yes[:, i] += np.bincount(owner[(found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=n)
        counts = np.maximum((yes - asked[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9), 0)
        best = counts.argmax(1)
        top = counts[np.arange(n), best]
        counts[np.arange(n), best] = 0
        second = counts.max(1) if counts.shape[1] > 1 else np.zeros(n)
        return best, np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0), top / np.maximum(asked, 1)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams and their summed counts."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, lang, n: each language's n-grams, counted over many batches, so that little is sent on for each text."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = _merged(parts)
            for i in range(0, len(keys), 1 << 16):
                some = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"gram": some.view(np.int64), "lang": pa.repeat(lang, len(some)), "n": n[i : i + (1 << 16)]})
        held.clear()

    size = 0
    for batch in batches:
        texts, langs = column(batch, "text"), batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for order in ORDERS:
                held.setdefault(lang, []).append(np.unique(grams(own, order)[0], return_counts=True))
                size += len(held[lang][-1][0])
        if size > 2 * HELD_GRAMS:
            for lang, parts in held.items():
                held[lang] = [_merged(parts)]
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > HELD_GRAMS:
                yield from give()
                size = 0
    yield from give()


def train(labelled: DataFrame, train_docs: int | None = None, max_grams: int = MAX_GRAMS) -> Filters | None:
    """Fit on doc_id, text and lang; rows with a null text or lang teach nothing. None without any.

    All rows teach, unless ``train_docs`` asks for about so many of them (by a hash of doc_id; rare
    languages have as much on top).
    """
    rows = labelled.filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    total, languages = sizes.agg(F.sum("rows"), F.count("*")).first()
    if not total:
        return None
    if train_docs is not None and total > train_docs:
        # A stated bound on the sample: the rows of the lowest hashes, of each language an equal part of the bound if it has so many.
        parts = sizes.orderBy(F.desc("rows"), "lang").limit(train_docs).select("lang", (train_docs / languages / F.col("rows")).alias("part"))
        part = F.greatest(F.lit(train_docs / total), F.col("part"))  # greatest skips nulls
        rows = rows.join(F.broadcast(parts), "lang", "left").filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < part * (1 << 30))

    tune(labelled.sparkSession)
    counts = rows.select("text", "lang").mapInArrow(tidy(_count_grams), "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    counts = spool(counts, "grams")
    # How many n-grams of a language have each count: as many rows as there are different counts.
    held = counts.groupBy("lang", "n").agg(F.count("*").alias("grams")).toPandas().sort_values(["lang", "n"], ascending=[True, False])
    if not len(held):
        return None
    fits = held["grams"].groupby(held["lang"]).cumsum() <= max(1, max_grams // languages)
    per = pd.DataFrame({"whole": (held["n"] * held["grams"]).groupby(held["lang"]).sum(), "least": held["n"].where(fits).groupby(held["lang"]).min()})
    # A language whose commonest n-grams alone are too many keeps those.
    per["least"] = per["least"].fillna(held.groupby("lang")["n"].max())
    known = counts.sparkSession.createDataFrame([(lang, int(r.whole), int(r.least)) for lang, r in per.iterrows()], "lang string, whole long, least long")
    rates = counts.join(F.broadcast(known), "lang").select("gram", "lang", (F.col("n") / F.col("whole")).alias("rate"), (F.col("n") >= F.col("least")).alias("kept"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    seen = rates.filter("kept").join(best, "gram").filter(F.col("rate") >= LEAST_SHARE * F.col("best")).select("gram", "lang").toPandas()
    if not len(seen):
        return None
    most = int(seen["lang"].value_counts().max())
    filters = Filters(sorted(seen["lang"].unique()), 1 << max(12, math.ceil(math.log2(ROWS_PER_GRAM * most))))
    for i, lang in enumerate(filters.languages):
        filters.add(seen.loc[seen["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64), i)
    filters.finish()
    return filters


def _median(steps: np.ndarray, n: np.ndarray) -> float:
    """Median of values between 0 and 1, of which n lie at each of CUT_STEPS steps."""
    order = np.argsort(steps)
    upto = np.cumsum(n[order])
    middle = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right")
    return float(steps[order][middle].mean()) / CUT_STEPS


def cuts(filters: Filters | None, held_out: DataFrame, cut: float = CUT) -> np.ndarray | None:
    """For each language the least known part of a text of it: ``cut`` of the median over its held-out texts.

    held_out: doc_id, text and lang of rows that taught nothing; all of them are looked at. A
    language without any takes the median of all, and 1 without those.
    """
    if filters is None:
        return None
    rows = held_out.filter("text is not null and lang is not null and text <> ''")
    model = held_out.sparkSession.sparkContext.broadcast(filters)

    def per_batch(batch: pa.RecordBatch) -> dict:
        filters, langs = model.value, batch.column(1).to_pylist()
        best, _, known = filters.decide(column(batch, "text"))
        return {"lang": langs, "own": [filters.languages[b] == lang for b, lang in zip(best.tolist(), langs, strict=True)], "known": known}

    found = map_batches(rows.select("text", "lang"), per_batch, "lang string, own boolean, known double").filter("own")
    found = found.groupBy("lang", F.round(F.col("known") * CUT_STEPS).cast("long").alias("step")).agg(F.count("*").alias("n")).toPandas()  # CUT_STEPS + 1 rows a language at most
    medians = {lang: _median(part["step"].to_numpy(), part["n"].to_numpy()) for lang, part in found.groupby("lang")}
    rest = _median(found["step"].to_numpy(), found["n"].to_numpy()) if len(found) else 1.0
    return cut * np.array([medians.get(lang, rest) for lang in filters.languages])


def identify(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """One row per row: doc_id, lang_pred, score.

    A null text, one without letters, and any text where nothing could be learned is ``und`` with
    score 0. Ties go to the first language by name. A text of letters none of whose n-grams is
    known gets the first language with score 0.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def per_batch(batch: pa.RecordBatch) -> dict:
        filters, texts = model.value, column(batch, "text")
        known = np.array(list(map(has_letter, texts))) & (filters is not None)
        pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if known.any():
            best, points, _ = filters.decide([t if ok else b"" for t, ok in zip(texts, known, strict=True)])
            pred[known] = np.array(filters.languages, object)[best[known]]
            score[known] = points[known]
        return {"doc_id": batch.column(0), "lang_pred": pred.tolist(), "score": score}

    return map_batches(documents(docs), per_batch, "doc_id long, lang_pred string, score double")


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2 and predict every row."""
    learn = documents(docs, F.col("lang").cast("string").alias("lang")).filter(F.coalesce(bucket(F.col("doc_id"), 4) != 2, F.lit(False)))
    return identify(docs, train(learn)).select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, filters: Filters | None, least: np.ndarray | None) -> DataFrame:
    """The rows of docs, all columns, with a letter, of which the best language knows its least part (see cuts()) or more."""
    model = docs.sparkSession.sparkContext.broadcast((filters, least))

    def run(batches):
        for batch in batches:
            (filters, least), texts = model.value, column(batch, "text")
            if filters is not None and texts:
                best, _, known = filters.decide(texts)
                yield batch.filter(pa.array(np.array(list(map(has_letter, texts))) & (known > 0) & (known >= least[best])))

    tune(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)

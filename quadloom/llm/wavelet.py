"""Token ids in a binary shard format: one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit-planes, most significant bit first. Each
plane keeps the bits of the ids in the order that the planes above have sorted them to (zeros
first, stably), with a rank directory of one count per 512 bits. ``WaveletMatrix`` answers from
the file alone: the id at a position, how often an id occurs before a position, and where its
k-th occurrence is; each takes one step per plane and inflates only the ``CHUNK`` bytes of the
planes that it looks at. ``count_id`` and ``find_id`` ask all shards of a folder.

Shards are rows of a Parquet table (one binary column), written by Spark's own committer: any
store works and a lost executor's half-written files never show.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.bpe import default_path, word_ids
from quadloom.llm.common import documents, regrouped, spans, tidy, tune
from quadloom.storage import fresh_dir

MAGIC, BLOCK = b"QLWM2\0", 512
#: Bytes of a plane that are compressed together.
CHUNK = 1 << 16
#: Tokens after which a task closes a shard; a document is never split over two.
SHARD_TOKENS = 1 << 21
END_ID = 2


def _popcounts(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits, and in all."""
    padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
    padded[: len(packed)] = packed
    return spans(np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.int64)).astype(np.uint32)


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """File bytes of a shard. doc_ids may hold nulls as a masked value; they are kept as given."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.ascontiguousarray(doc_ids, "<i8").tobytes()), pack(np.ascontiguousarray(lengths, "<u4").tobytes())]
    now = ids.astype(np.uint16 if width <= 16 else np.uint32)
    for level in range(width - 1, -1, -1):
        ones = (now & now.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        raw = packed.tobytes()
        parts += [pack(_popcounts(packed).astype("<u4").tobytes()), *[pack(raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK)]]
        if level:
            now = np.concatenate([now.compress(~ones), now.compress(ones)])
    head = struct.pack("<6sBQQ", MAGIC, width, len(ids), len(doc_ids)) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


class WaveletMatrix:
    """Parts of the file (document ids, lengths, and for each plane its ranks and chunks) are inflated when first looked at."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.n, n_docs = struct.unpack_from("<6sBQQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<6sBQQ")
        self.chunks = -(-self.n // (8 * CHUNK))
        sizes = struct.unpack_from(f"<{2 + self.width * (1 + self.chunks)}Q", data, at)
        self._data, self._at = data, (at + 8 * len(sizes) + spans(np.array(sizes, np.int64))).tolist()
        self._inflate = zstandard.ZstdDecompressor().decompress
        self._parts: dict[int, np.ndarray] = {}

    def _part(self, number: int, kind: str) -> np.ndarray:
        if number not in self._parts:
            self._parts[number] = np.frombuffer(self._inflate(self._data[self._at[number] : self._at[number + 1]]), kind)
        return self._parts[number]

    @property
    def inflated(self) -> int:
        """Parts looked at so far."""
        return len(self._parts)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._part(0, "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return self._part(1, "<u4").astype(np.int64)

    def _ranks(self, level: int) -> np.ndarray:
        return self._part(2 + level * (1 + self.chunks), "<u4")

    def _chunk(self, level: int, chunk: int) -> np.ndarray:
        return self._part(3 + level * (1 + self.chunks) + chunk, "u1")

    def _plane(self, level: int) -> np.ndarray:
        """All bits of a plane."""
        packed = [self._chunk(level, i) for i in range(self.chunks)]
        return np.unpackbits(np.concatenate(packed) if packed else np.empty(0, np.uint8), count=self.n, bitorder="little").view(bool)

    def _zeros(self, level: int) -> int:
        return self.n - int(self._ranks(level)[-1])

    def _block(self, level: int, block: int) -> np.ndarray:
        """The bytes of 512 bits; none behind the end."""
        chunk, byte = divmod(block * BLOCK // 8, CHUNK)
        return self._chunk(level, chunk)[byte : byte + BLOCK // 8] if chunk < self.chunks else np.empty(0, np.uint8)

    def _ones(self, level: int, at: int) -> int:
        """Set bits of a plane before position at."""
        block, bits = divmod(at, BLOCK)
        ones = int(self._ranks(level)[block])
        if bits:
            rest = self._block(level, block)[: -(-bits // 8)].copy()
            if bits % 8:
                rest[-1] &= (1 << bits % 8) - 1
            ones += int(np.bitwise_count(rest).sum())
        return ones

    def _bit(self, level: int, at: int) -> int:
        return int(self._block(level, at // BLOCK)[at % BLOCK >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.width):
            bit = self._bit(level, at)
            value = value << 1 | bit
            ones = self._ones(level, at)
            at = self._zeros(level) + ones if bit else at - ones
        return value

    def rank(self, value: int, at: int) -> int:
        """How many of the first ``at`` ids equal value."""
        if value >> self.width or value < 0:
            return 0
        low, high = 0, min(max(at, 0), self.n)
        for level in range(self.width):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self._zeros(level) + a, self._zeros(level) + b) if value >> (self.width - 1 - level) & 1 else (low - a, high - b)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of value; -1 if there are fewer."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        low = 0
        for level in range(self.width):
            ones = self._ones(level, low)
            low = self._zeros(level) + ones if value >> (self.width - 1 - level) & 1 else low - ones
        at = low + k
        for level in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - level) & 1
            at = self._find(level, at - self._zeros(level) if one else at, one)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of value, ascending: the range of the last plane, led back up plane by plane."""
        if value >> self.width or value < 0:
            return np.empty(0, np.int64)
        low, high, ranges = 0, self.n, []
        for level in range(self.width):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self._zeros(level) + a, self._zeros(level) + b) if value >> (self.width - 1 - level) & 1 else (low - a, high - b)
            ranges.append(high - low)
        at = np.arange(low, high)
        for level in range(self.width - 1, -1, -1):
            if not len(at):
                break
            one = value >> (self.width - 1 - level) & 1
            at = np.flatnonzero(self._plane(level) == bool(one))[at - self._zeros(level) if one else at]
        return at

    def _find(self, level: int, k: int, one: int) -> int:
        """Position of set (or clear) bit k of a plane."""
        ranks = self._ranks(level).astype(np.int64)
        if not one:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        bits = np.unpackbits(self._block(level, block), bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def tokens(self) -> np.ndarray:
        """All ids, undoing the planes from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            ones = self._plane(level)
            back = np.empty_like(now)
            # Places by flatnonzero: several times faster than a boolean mask on mixed bits.
            back[np.flatnonzero(~ones)] = now[: self._zeros(level)]
            back[np.flatnonzero(ones)] = now[self._zeros(level) :] | now.dtype.type(1 << (self.width - 1 - level))
            now = back
        return now.astype(np.uint32)

    def near(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and place in it of positions."""
        first = spans(self.lengths)
        doc = np.searchsorted(first, at, "right") - 1
        return self.doc_ids[doc], at - first[doc]


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, block, base = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal held, size, block, base
        ids, docs, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
        row = pa.RecordBatch.from_pydict({"shard": [part], "block": [block], "base": [base], "n_tokens": [len(ids)], "n_docs": [len(docs)], "payload": [encode_shard(ids, docs, lengths)]}, schema=pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("base", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())]))
        block, base, held, size = block + 1, base + len(ids), [], 0
        return row

    for batch in regrouped(batches):
        if not batch.num_rows:
            continue
        ids, offsets, _ = word_ids(path).encode(batch.column(1))
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((np.insert(ids, offsets[1:], end_id), docs, np.diff(offsets) + 1))
        size += len(ids) + len(docs)
        if size >= limit:
            yield close()
    if held:
        yield close()


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenize documents and write them as wavelet shards in ascending doc_id order.

    A null text counts as empty (its ids are the end id alone); rows with a null doc_id are not
    documents and are left out; rows that repeat a doc_id stay, ordered by text. An empty table
    writes no shard.
    """
    file = tokenizer or default_path()
    tune(docs.sparkSession)
    ordered = documents(docs).filter("doc_id is not null").withColumn("text", F.coalesce("text", F.lit(""))).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(lambda it: _shards(it, file, end_id, shard_tokens)), "shard long, block long, base long, n_tokens long, n_docs long, payload binary").write.option("compression", "uncompressed").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, and where its ids lie (shard, block)."""
    shards = spark.read.schema("shard long, block long, base long, n_tokens long, n_docs long, payload binary").parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, base, payload = (batch.column(i)[row].as_py() for i in (0, 1, 2, 3))
                matrix = WaveletMatrix(payload)
                raw, offsets = memoryview(matrix.tokens().astype("<u4").tobytes()), spans(matrix.lengths)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(matrix.doc_ids, pa.int64()), "within": pa.array(base + offsets[:-1], pa.int64()), "n_tokens": pa.array(matrix.lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array(np.full(n, shard)), "block": pa.array(np.full(n, block))})

    rows = shards.select("shard", "block", "base", "payload").mapInArrow(tidy(decode), "doc_id long, within long, n_tokens long, ids_crc32 long, shard long, block long")
    # One row per writing task, never per document: this window stays small at any input size.
    before = shards.groupBy("shard").agg(F.sum("n_tokens").alias("held")).select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def _ask(spark, path: str, answer, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict(answer(WaveletMatrix(payload)))

    return spark.read.schema("payload binary").parquet(path).mapInArrow(tidy(run), schema)


def count_id(spark, path: str, value: int) -> int:
    """How often an id occurs in all shards of a folder; 0 in an empty one."""
    return _ask(spark, path, lambda m: {"n": [m.rank(value, m.n)]}, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def find_id(spark, path: str, value: int) -> DataFrame:
    """Every occurrence of an id in all shards of a folder: doc_id and at (its place among the document's ids)."""

    def answer(m: WaveletMatrix) -> dict:
        docs, at = m.near(m.occurrences(value))
        return {"doc_id": pa.array(docs, pa.int64()), "at": pa.array(at, pa.int64())}

    return _ask(spark, path, answer, "doc_id long, at long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards into the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "wavelet")
    write_shards(docs, path, tokenizer)
    return read_shards(spark, path)


__all__ = ["WaveletMatrix", "count_id", "encode_shard", "find_id", "read_shards", "round_trip", "write_shards"]

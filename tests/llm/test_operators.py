"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from brute import plain_patience, removed_by_all_pairs
from quadloom.llm import bpe, components, decontam, langid, linedup, packing, quality, queries, simhash, substring, toxicity, wavelet, wordpiece

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_word_ids_equal_whole_texts(tokenizer):
    rng = random.Random(5)
    letters = "abcxyzABCÉéßÀñ.,!?;:'\"-_<|>0123 \t\n\r\x0b\x0c İΣσςḰ…。中文한グﬁ́"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>x", "a<|endoftext|>B.C <|STARTOFTEXT|> <|startoftext|>", "", "I'll don't we've"]
    for words in (bpe.CACHE_WORDS, 50):
        coder = bpe.WordIds(bpe.default_path())
        old, bpe.CACHE_WORDS = bpe.CACHE_WORDS, words
        try:
            for start in range(0, len(made), 700):
                some = made[start : start + 700]
                ids, at, _ = coder.encode(pa.array(some))
                for i, text in enumerate(some):
                    assert tokenizer.encode(text, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist()
        finally:
            bpe.CACHE_WORDS = old


def test_other_vocabularies_are_left_to_the_library(docs):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(bpe.default_path(), encoding="utf-8") as file, open(path, encoding="utf-8") as other:
        assert bpe.by_words(json.load(file)) and not bpe.by_words(json.load(other))
    made = ["Two  words.\n\tThree", "", None, "caf\u00e9 \u4e2d UPPER"]
    ids, at, ends = bpe.WordIds(path).encode(pa.array(made))
    library = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in made] and not len(ends)
    rows = packing.pack(docs.limit(20), tokenizer=path, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.limit(20).collect())


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 50_000) % 49_000).astype(np.uint32)
    matrix = wavelet.WaveletMatrix(wavelet.encode_shard(ids, np.arange(3), np.array([1, 2, 3])))
    assert (matrix.tokens() == ids).all() and matrix.doc_ids.tolist() == [0, 1, 2] and matrix.lengths.tolist() == [1, 2, 3]
    assert all(matrix.access(int(i)) == ids[i] for i in rng.integers(0, len(ids), 100))
    for value in (0, 1, 2, 77, 48_999, 65_535, 1 << 20):
        at = np.flatnonzero(ids == value)
        assert [matrix.rank(value, n) for n in (0, 1, 25_000, 50_000)] == [int((at < n).sum()) for n in (0, 1, 25_000, 50_000)]
        ks = sorted({0, 1, 2, 3, len(at) // 3, len(at) // 2, len(at) - 2, len(at) - 1} & set(range(len(at))))
        assert [matrix.select(value, k) for k in ks] == at[ks].tolist() and matrix.select(value, len(at)) == -1 and matrix.select(value, -1) == -1
        assert matrix.occurrences(value).tolist() == at.tolist()
    empty = wavelet.WaveletMatrix(wavelet.encode_shard(np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)))
    assert empty.n == 0 and len(empty.tokens()) == 0 and empty.rank(1, 5) == 0 and empty.select(1, 0) == -1 and len(empty.occurrences(0)) == 0


def test_wavelet_queries_inflate_little(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 128)
    ids = np.random.default_rng(2).integers(0, 500, 30_000).astype(np.uint32)
    data = wavelet.encode_shard(ids, np.array([4]), np.array([30_000]))
    for ask, want in ((lambda m: m.access(12_345), ids[12_345]), (lambda m: m.rank(77, 20_000), (ids[:20_000] == 77).sum()), (lambda m: m.select(3, 20), np.flatnonzero(ids == 3)[20])):
        matrix = wavelet.WaveletMatrix(data)
        assert ask(matrix) == want and matrix.inflated <= 5 * matrix.width < matrix.width * matrix.chunks
    assert (wavelet.WaveletMatrix(data).tokens() == ids).all()


def test_ids_in_a_folder_of_shards(spark, docs, texts, tokenizer, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs, path, shard_tokens=5000)
    all_ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts}
    for value in (2, all_ids[texts[5][0]][3], 48_000, 1 << 30):
        want = sorted((d, i) for d, ids in all_ids.items() for i, x in enumerate(ids) if x == value)
        assert wavelet.count_id(spark, path, value) == len(want) and sorted(map(tuple, wavelet.find_id(spark, path, value).collect())) == want


def test_round_trip(spark, docs, texts, tokenizer):
    start = 0
    for (doc, text), row in zip(texts, sorted(queries.op1_wavelet_shards(spark, SMALL).collect()), strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def _cost(n, size):
    """Padding of a sequence of n tokens, by the contract: to the full size, except at a power of two."""
    return 0 if n & (n - 1) == 0 else size - n


def _best(at, penalty, size):
    """All transitions, without the queue."""
    cost = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= size and cost[i] is not None:
                now = cost[i] + _cost(n, size) + penalty[j]
                cost[j] = now if cost[j] is None else min(cost[j], now)
    return cost[-1]


def test_packing_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(120):
        lengths = rng.integers(1, 90, rng.integers(1, 12))
        ends = np.cumsum(lengths)
        sentences = np.unique(rng.integers(1, ends[-1] + 1, 8))
        at, penalty = packing.boundaries(ends, sentences, 64)
        cuts = packing.best_cuts(at, penalty, 64)
        where = dict(zip(at.tolist(), penalty.tolist(), strict=True))
        cost = sum(_cost(b - a, 64) + where[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert max(np.diff(cuts)) <= 64 and cuts[0] == 0 and cuts[-1] == ends[-1] and cost == _best(at.tolist(), penalty.tolist(), 64)
        tail = packing.split_tail(cuts, 64)
        assert tail[-1] == cuts[-1] and tail[: len(cuts) - 1] == cuts[:-1]
    assert packing.best_cuts(*packing.boundaries(np.array([128, 2176]), np.empty(0, np.int64))) == [0, 128, 2176]


@pytest.mark.parametrize("block", [1, 3000, 20_000])
def test_packing_in_several_blocks(docs, texts, tokenizer, monkeypatch, block):
    """A task's documents in blocks: every id once and in order, sequences whole, little more cost than in one block."""
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)})))
    some = texts[:90]
    batches = lambda: iter([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in some[i : i + 5]], "text": [t for _, t in some[i : i + 5]]}) for i in range(0, len(some), 5)])

    def run(size):
        monkeypatch.setattr(packing, "BLOCK_TOKENS", size)
        with monkeypatch.context() as m:
            m.setattr(packing, "regrouped", lambda batches: batches)
            return pa.Table.from_batches(packing._pack(batches(), bpe.default_path(), 1, 2048, True)).to_pandas()

    whole, rows = run(1 << 30), run(block)
    for doc, text in some:
        own = rows[rows.doc_id == doc].sort_values("start")
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert [i for piece in own.ids for i in piece] == ids and set(own.doc_tokens) == {len(ids)} and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
    assert sorted(set(rows.sequence_id)) == [(3 << 40) + i for i in range(rows.sequence_id.nunique())]
    used = [rows.groupby("sequence_id")["length"].sum(), whole.groupby("sequence_id")["length"].sum()]
    for sequence, own in rows.groupby("sequence_id"):
        assert own.sort_values("offset").offset.tolist() == [0, *np.cumsum(own.sort_values("offset").length)[:-1]]
    padding, best = (sum(_cost(int(n), 2048) for n in x) for x in used)
    assert used[0].max() <= 2048 and padding <= best + 0.02 * used[0].sum()


def test_packing_whole(docs, texts, tokenizer):
    rows = packing.pack(docs, with_ids=True).toPandas()
    used = {}
    for doc, text in texts:
        own = rows[rows.doc_id == doc].sort_values("start")
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert [i for piece in own.ids for i in piece] == ids and set(own.doc_tokens) == {len(ids)}
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids]
    for sequence, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        used[sequence] = int(own.length.sum())
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert max(used.values()) <= 2048 and padding < 0.03 * sum(used.values())


def test_language_held_out(spark):
    rows = langid.predict(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_language_against_plain_sets(spark, docs):
    """The same rule with sets in place of filters: what is left is the filters' noise around their expectation."""
    rows = [r for r in docs.collect() if r.text]
    learn = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    blank = lambda t: b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t.lower().encode()) + b" "
    pieces = lambda t: [(n, b[i : i + n]) for b in [blank(t)] for n in (3, 5) for i in range(len(b) - n + 1)]
    counts = collections.defaultdict(collections.Counter)
    for r in learn:
        counts[r.lang].update(pieces(r.text))
    rates = {lang: {g: n for g, n in c.items() if n >= langid.LEAST_COUNT} for lang, c in counts.items()}
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in rates.items()}
    own = {lang: {g for g, x in c.items() if x >= langid.LEAST_SHARE * max(other.get(g, 0) for other in rates.values())} for lang, c in rates.items()}
    got, same, near = {r.doc_id: r for r in langid.predict(docs).collect()}, 0, 0
    for r in rows:
        found = sorted(((sum(g in s for g in pieces(r.text)), lang) for lang, s in own.items()), key=lambda x: (-x[0], x[1]))
        same += got[r.doc_id].lang_pred == found[0][1]
        near += abs(got[r.doc_id].score - found[0][0] / max(1, found[0][0] + found[1][0])) < 0.02
    assert same >= 0.99 * len(rows) and near >= 0.97 * len(rows)


def test_language_stage_rejects_what_was_not_learned(spark):
    """Spanish held out of the labels, and letter noise, go; texts of the learned languages stay."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(6)
    noise = spark.createDataFrame([(10**6 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300)), None) for i in range(60)], "doc_id long, text string, lang string")
    docs = table.select("doc_id", "text", F.when(F.col("lang") != "es", F.col("lang")).alias("lang")).unionByName(noise)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    rows = table.filter("text is not null and text rlike '[a-z]'").collect()
    foreign, own = [r.doc_id for r in rows if r.lang == "es"], [r.doc_id for r in rows if r.lang and r.lang != "es"]
    assert not [d for d in kept if d >= 10**6]
    assert sum(d in kept for d in foreign) <= 0.1 * len(foreign) and sum(d in kept for d in own) >= 0.995 * len(own)


def test_language_filters_have_no_misses():
    rng = np.random.default_rng(2)
    filters = langid.Filters(["a", "b", "c"], 1 << 14)
    keys = rng.integers(0, 1 << 40, (3, 400)).astype(np.uint64)
    for i in range(3):
        filters.add(keys[i], i)
    filters.finish()
    for i in range(3):
        assert (filters.languages_of(keys[i])[:, 0] >> np.uint64(i) & np.uint64(1)).all()
    strange = rng.integers(1 << 41, 1 << 42, 20_000).astype(np.uint64)
    for i in range(3):
        assert abs((filters.languages_of(strange)[:, 0] >> np.uint64(i) & np.uint64(1)).mean() - filters.chance[i]) < 0.003


def test_wordpiece_brute_force(docs, texts):
    initial, later = map(set, wordpiece.vocabulary(wordpiece.default_path()))

    def brute(word, first=initial, rest=later):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
            if end is None:
                return 0
            at, n = end, n + 1
        return n

    rng = random.Random(4)
    for _ in range(20):
        first, rest = ({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)} for _ in range(2))
        automaton = wordpiece.Automaton(sorted(first), sorted(rest))
        for _ in range(300):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
            assert automaton.count(word) == brute(word, first, rest), (word, first, rest)
    for (_, text), row in zip(texts, sorted(wordpiece.count_tokens(docs).collect()), strict=True):
        counts = [brute(w.decode()) for w in text.encode().split()]
        assert (row.n_words, row.n_tokens, row.n_unknown) == (len(counts), sum(c or 1 for c in counts), counts.count(0))


def test_patience():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        if a == b:
            assert len(pairs) == len(a)
    assert linedup.patience("xabcy", "zabcw") == [(1, 1), (2, 2), (3, 3)]


def test_patience_by_the_book():
    rng = random.Random(17)
    for _ in range(300):
        a, b = rng.sample("abcdefghijkl", 9), rng.sample("abcdefghijkl", 9)
        assert all(a[i] == b[j] for i, j in linedup.patience(a, b)) and len(linedup.patience(a, b)) == len(plain_patience(a, b))


def test_line_dedup_against_all_pairs(docs, texts):
    """What aligning every two documents that share a line removes: 99 % of it goes, and hardly a line besides (ties between equally long runs)."""
    want = {(d, j) for d, lines in removed_by_all_pairs(dict(texts)).items() for j in lines}
    got = set()
    for r in linedup.deleted_lines(docs.select("doc_id", "text").filter("text is not null")).collect():
        got |= {(r.doc_id, j) for j, gone in enumerate(r.gone) if gone}
    assert len(want) > 200 and len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.02 * len(want)
    split = {d: t.split("\n") for d, t in texts}
    for r in linedup.remove_lines(docs.select("doc_id", "text")).collect():
        assert (r.text or "") == "\n".join(x for j, x in enumerate(split[r.doc_id]) if (r.doc_id, j) not in got) or r.n_removed == len(split[r.doc_id])
        assert r.n_removed == sum(d == r.doc_id for d, _ in got)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.predict(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    right = [r for r in rows if r.predicted == 1]
    assert sum(r.toxic for r in right) > 0.85 * len(right) and sum(r.predicted for r in rows if r.toxic) > 0.85 * sum(r.toxic for r in rows)


def test_scores_against_plain_loops():
    """The forward pass word by word and number by number, over every window."""
    from math import exp, tanh

    net = toxicity.Network(5)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "two", "idiot", "Three", "x", "caf\u00e9", "42"]) for _ in range(n)).encode() for n in (1, 7, 32, 33, 50, 70)] + [b"", b" ... "]
    p = {k: v.astype(float) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + exp(-x))

    def embed(word):
        row = int.from_bytes(xxhash.xxh32_digest(word), "big") % toxicity.WORD_ROWS
        framed, rows = b"\x01" + word + b"\x02", []
        for order in toxicity.ORDERS:
            for i in range(len(framed) - order + 1):
                key = int.from_bytes(bytes([0] * (8 - order)) + framed[i : i + order], "big") + (order << 8 * order)
                rows.append((key * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % toxicity.CHAR_ROWS)
        mean = sum((p["char"][r] for r in rows), np.zeros(toxicity.CHAR_DIM)) / max(len(rows), 1) ** 0.5
        return np.concatenate([p["word"][row], mean])

    def states(xs, d):
        state, out = np.zeros(h), []
        for x in xs:
            g, u = x @ p["w"][d] + p["b"][d][0], p["u"][d]
            z = [sigmoid(g[k] + sum(state[i] * u[i, k] for i in range(h))) for k in range(h)]
            r = [sigmoid(g[h + k] + sum(state[i] * u[i, h + k] for i in range(h))) for k in range(h)]
            q = [tanh(g[2 * h + k] + sum(r[i] * state[i] * u[i, 2 * h + k] for i in range(h))) for k in range(h)]
            state = np.array([state[k] + z[k] * (q[k] - state[k]) for k in range(h)])
            out.append(state)
        return out

    def window(words):
        xs = [embed(w) for w in words]
        both = [np.concatenate(pair) for pair in zip(states(xs, 0), states(xs[::-1], 1)[::-1], strict=True)]
        weight = [exp(sum(tanh(s @ p["a"][:, k]) * p["v"][k] for k in range(h))) for s in both]
        return sigmoid(sum(w * (s @ p["o"]) for w, s in zip(weight, both, strict=True)) / sum(weight) + p["c"][0])

    for text, got in zip(texts, toxicity.Scorer(net).scores(texts), strict=True):
        words = toxicity.tokens(text)
        starts = range(0, max(len(words) - toxicity.WINDOW + toxicity.STRIDE, 1), toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]
        assert abs(got - max((window(words[s : s + toxicity.WINDOW]) for s in starts if words), default=0.0)) < 1e-4


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"word{i} " * (1 + 400 * (i == 3)) + ("idiot" if i % 2 else "fine")) for i in range(8)] + [(1, "a second text of the same document")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    taught: list = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: taught.append((texts, marks.tolist())))
    toxicity.fit(docs, labels)
    toxicity.fit(docs, labels, train_bytes=1000)
    learn = [i for i in range(8) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(taught[0][0]) == len(learn) and taught[0][1] == [i % 2 for i in learn]
    assert len(taught[1][0]) == len([i for i in learn if i != 3]) and max(map(len, taught[1][0])) < 1000


def test_gradients_match_differences():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary = [b"one", b"two", b"three", b"idiot"]
    rng = np.random.default_rng(0)
    index = rng.integers(0, 4, (5, 6))
    mask = np.arange(6) < np.array([6, 4, 1, 6, 3])[:, None]
    label, share = np.array([1.0, 0, 1, 0, 1]), np.full(5, 0.2)

    def loss():
        p = net.score(net.project(net.embed(vocabulary)[0]), index, mask)
        return float(-(share * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum())

    x, parts = net.embed(vocabulary)
    found = net.gradients(x, parts, index, mask, label, share)
    for name, at in (("w", (0, 3, 5)), ("w", (1, 9, 20)), ("u", (0, 2, 3)), ("u", (1, 5, 20)), ("b", (1, 0, 7)), ("a", (4, 2)), ("v", (3,)), ("o", (9,)), ("c", (0,)), ("char", (int(parts[1][0][0][0]), 4)), ("word", (int(parts[0][1]), 2))):
        old, losses = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            losses.append(loss())
        net.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - found[name][at]) < 2e-3, name


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (12, 2))]]))
    rng.shuffle(points)
    tree = np.sort(rng.integers(0, 3, len(points)))
    forest = simhash.Forest(points, tree)
    for t in range(3):
        inside = np.flatnonzero(tree == t)
        q, p = forest.search(points, np.full(len(points), forest.root[t]), 2)
        want = {(i, int(j)) for i in range(len(points)) for j in inside if (int(points[i]) ^ int(points[j])).bit_count() <= 2}
        assert set(zip(q.tolist(), p.tolist(), strict=True)) == want


def test_finer_masks():
    for mask in (0, 0b1011, (1 << 43) - 1, (1 << 64) - 8):
        parts = [new ^ mask for new in simhash.finer(mask, 2)]
        assert sum(parts) == (1 << 64) - 1 - mask and all(p & q == 0 for p in parts for q in parts if p is not q) and all(p & mask == 0 and p for p in parts)


def test_links_of_many_that_share_a_block(spark):
    """20,000 fingerprints that agree in 21 bits, with planted neighbours: no row count near the square, no link lost."""
    rng = random.Random(9)
    low = (1 << 21) - 1
    base = [rng.getrandbits(63) & ~low | 0x12345 for _ in range(18_000)]
    near = [b ^ (1 << rng.randrange(21, 62)) ^ (1 << rng.randrange(21, 62)) for b in base[:2000]]
    made = spark.createDataFrame([(f,) for f in {*base, *near}], "fp long")
    roots = {r.u: r.v for r in components.components(simhash.links(made, tree_nodes=256)).collect()}
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in zip(base, near, strict=False)) and len(roots) <= 2100


@pytest.mark.parametrize("nodes", [3, 4096])
def test_links_keep_components(spark, nodes):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    points = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), tree_nodes=nodes)
    roots = {r.u: r.v for r in components.components(links).collect()}
    found, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, s in enumerate(signed):
        found[roots.get(s, s)].add(s)
        want[find(i)].add(s)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_simhash_fingerprints(spark, texts):
    def brute(text):
        words = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"

    rows = sorted(queries.op7_simhash_bktree(spark, SMALL).collect())
    assert [r.fingerprint for r in rows] == [brute(t) for _, t in texts]
    value = [int(r.fingerprint, 16) for r in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(label)
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (value[i] ^ value[j]).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
        if label == before:
            break
    assert [r.component_id for r in rows] == [texts[k][0] for k in label]


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (101, 100), (None, 5), (7, None), (101, 100)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(a, b) == table[-1][-1]


def test_leaks_against_brute_force_and_paraphrases(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    host = docs.orderBy("doc_id").limit(1).collect()[0].text.split()
    changed = []
    for k, r in enumerate(items[:12]):
        words = r.text.split()
        for i in range(3, len(words) - len(words) // 5, 9):
            words[i] = "changed"
        changed.append((10_000 + k, " ".join(host[:100] + words + host[100:160])))
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(changed, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(every, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    grams = lambda t: {tuple(w) for w in zip(*[decontam.tokens(t.encode())[k:] for k in range(5)], strict=False)}
    known = {r.item_id: grams(r.text) for r in items}
    want = {(d.doc_id, i) for d in every.collect() if (own := grams(d.text)) for i, g in known.items() if g and len(own & g) >= 0.8 * len(g)}
    want |= {(10_000 + k, r.item_id) for k, r in enumerate(items[:12])}
    assert len(want & got) >= 0.95 * len(want) and not got - want


def test_rolling_and_minimizers():
    h = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    for length in (1, 2, 20, 50):
        with np.errstate(over="ignore"):
            got = substring.rolling(h, length)
        want = []
        for i in range(len(h) - length + 1):
            v = 0
            for x in h[i : i + length]:
                v = (v * int(substring.BASE) + int(x)) % (1 << 64)
            want.append(v)
        assert got.tolist() == want
    assert substring.sliding_min(h, 31).tolist() == [min(h[i : i + 31]) for i in range(270)]
    assert substring.merged(np.array([5, 0, 3, 55, 200]), 50) == [(0, 105), (200, 250)]


@pytest.mark.parametrize("name", ["op2_line_quality", "op9_repeated_windows"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_short_lines_go_with_their_block(spark):
    block = ["Ok.", "The first long line of the block.", "Les.", "", "The second long line of the block.", "End."]
    rows = [
        (1, "\n".join(block)),
        (2, "\n".join(block)),
        (3, "\n".join(["Les.", "Only this document holds the line.", *block, "Les.", "Only this one, too, holds the line.", "Ok."])),
        (4, "Les.\nOk.\nNothing here is shared at all."),
    ]
    got = {r.doc_id: (r.text, r.n_removed) for r in linedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 6), 3: ("Les.\nOnly this document holds the line.\nLes.\nOnly this one, too, holds the line.\nOk.", 6), 4: (rows[3][1], 0)}


def test_blocks_whose_lines_stand_earlier_in_another_order(spark):
    block = [f"Line {i} of a block that two documents share." for i in range(5)]
    rows = [
        (1, "\n".join(block[::-1])),
        (2, "\n".join(["Only the second document has this.", *block[:2], "Nor does any other have this.", *block[2:]])),
        (3, "\n".join([*block[:2], "Only the third document has this.", *block[2:], "Its last line."])),
        (4, "One line.\nThe long line of two."),
        (5, "The long line of two."),
        (6, "Two.\nThe long line of two.\nEnd."),
        (7, "Two.\nThe long line of two.\nEnd."),
    ]
    got = {r.doc_id: r.text for r in linedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == "Only the third document has this.\nIts last line." and got[5] == got[7] == "" and got[6] == "Two.\nEnd."


def test_paraphrases_are_found(spark):
    """Reworded (every fourth word), with neighbours swapped and with halves swapped; other prose of the same words is not."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    hosts = [r.text.split() for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 160][:20]
    rng = random.Random(3)
    known = sorted({w for h in hosts for w in h})

    def reworded(words):
        return [rng.choice(known) if i % 4 == 1 and i < len(words) - len(words) // 5 else w for i, w in enumerate(words)]

    def swapped(words):
        return [w for i in range(0, len(words), 4) for w in (words[i : i + 2][::-1] + words[i + 2 : i + 4])]

    kinds = [reworded, swapped, lambda w: w[len(w) // 2 :] + w[: len(w) // 2], lambda w: rng.sample(w, len(w))]
    rows = [(10_000 * (k + 1) + r.item_id, " ".join([*hosts[r.item_id % len(hosts)][:80], *kind(r.text.split()), *hosts[r.item_id % len(hosts)][80:160]])) for k, kind in enumerate(kinds) for r in items]
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    found = [sum((10_000 * (k + 1) + r.item_id, r.item_id) in got for r in items) for k in range(len(kinds))]
    assert min(found[:3]) >= 0.9 * len(items) and found[3] <= 0.1 * len(items)


def test_short_items_among_2000(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    rng = random.Random(12)
    known = sorted({w for r in docs for w in decontam.tokens((r.text or "").encode())})
    items = [[rng.choice(known).decode() for _ in range(rng.randint(3, decontam.EXACT - 1))] for _ in range(2000)]
    host = [[rng.choice(known).decode() for _ in range(120)] for _ in range(400)]
    for k, h in enumerate(host):
        words = list(items[k])
        if len(words) >= decontam.SHORT and k % 2:
            del words[2], words[-3]
        h[60:60] = words
    made = spark.createDataFrame([(k, " ".join(h)) for k, h in enumerate(host)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(made, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    want = set()
    for k, h in enumerate(host):
        text = [w.encode() for w in h]
        for i, item in enumerate(items):
            words = [w.encode() for w in item]
            if len(set(words) & set(text)) >= decontam.PARAPHRASE * len(set(words)):
                spread = range(len(text) - len(words) + 1)
                if len(words) < decontam.SHORT and any(text[s : s + len(words)] == words for s in spread):
                    want.add((k, i))
                if len(words) >= decontam.SHORT and any(decontam.common_subsequence(words, text[s : s + len(words)]) >= decontam.MATCH * len(words) for s in spread):
                    want.add((k, i))
    assert want >= {(k, k) for k in range(400) if not (k % 2 and len(items[k]) in (8, 9, 10, 11) and 2 > 0.25 * len(items[k]))}
    assert want <= got
    assert all((k, i) in want or decontam.common_subsequence([w.encode() for w in items[i]], [w.encode() for w in host[k]]) >= decontam.PARAPHRASE * len(items[i]) for k, i in got)


def test_fingerprints_in_pieces(monkeypatch):
    """Texts cut into pieces of any size have the fingerprints of whole ones, and a long text takes memory like its own size."""
    import tracemalloc

    rng = random.Random(11)
    odd = [b"".join(rng.choice([b"a", b"B", b" ", b"\n", b"\x0b", "\u00e9".encode(), b"\x1c", b"xy"]) for _ in range(rng.randint(0, 50))) for _ in range(400)]

    def plain(text, shingle):
        ws = text.lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + shingle]), 42) for i in range(max(1, len(ws) - shingle + 1))] if ws else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    long = b" ".join(rng.randbytes(3).hex().encode() for _ in range(500_000))
    tracemalloc.start()
    whole = simhash.fingerprint_batch([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and int(whole[0]) == plain(long, 3)
    for shingle in (1, 3):
        want = [plain(t, shingle) for t in odd]
        for piece, hashes in ((1, 1), (5, 3), (20, 1 << 16), (1 << 18, 1 << 16)):
            monkeypatch.setattr(simhash, "PIECE", piece)
            monkeypatch.setattr(simhash, "HASHES", hashes)
            assert simhash.fingerprint_batch(odd, shingle).tolist() == want


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the common language speaks of many things and of number {chr(97 + i % 26)} too", "aa") for i in range(2000)] + [(5000 + i, "жили были старик со старухой у самого синего моря", "bb") for i in range(4)]
    filters = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=20, max_grams=120)
    assert filters.languages == ["aa", "bb"] and filters.decide(["старик у моря".encode()])[0][0] == 1


def test_latent_model_comes_from_all_documents(spark, monkeypatch):
    """Other ids of the same texts, more than any sample held, give the same basis; the counts behind it are those of all texts."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    texts += [f"{t} {i}" for i, t in enumerate(texts)]
    found, fit = [], decontam.latent_basis
    monkeypatch.setattr(decontam, "latent_basis", lambda *a: found.append(fit(*a)) or found[-1])
    for shift in (0, 7):
        docs = spark.createDataFrame([(i + shift, t) for i, t in enumerate(texts)], "doc_id long, text string")
        decontam.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet").limit(20))
    assert len(found) == 2 and len(texts) > 1500 and (found[0] == found[1]).all()


def test_recall_of_the_latent_search_against_brute_force(spark):
    """All windows of all documents held against all passages by the same checks: the benchmark's items, altered, in other prose."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    rng = random.Random(5)
    vocabulary = [w for _, t in docs[:100] for w in t.split()]
    kinds = [
        lambda ws: [w for w in ws if rng.random() > 0.15],
        lambda ws: [w if rng.random() > 0.2 else rng.choice(vocabulary) for w in ws],
        lambda ws: [x for w in ws for x in ([w, rng.choice(vocabulary)] if rng.random() < 0.3 else [w])],
        lambda ws: [*[w for w in ws[: -max(1, len(ws) // 5)] if rng.random() > 0.4], *ws[-max(1, len(ws) // 5) :]],
    ]
    for k, kind in enumerate(kinds):
        for r in items:
            host = rng.choice(docs)[1].split()[:150]
            cut = rng.randrange(len(host) + 1)
            docs.append((1_000_000 * (k + 1) + r.item_id, " ".join([*host[:cut], *kind(r.text.split()), *host[cut:]])))
    passages = decontam.Items([r.item_id for r in items], [r.text.encode() for r in items], np.zeros((decontam.DIMS, 1), np.float32), np.ones(decontam.DIMS, np.float32))
    want = set()
    for doc, text in docs:
        words = decontam.tokens(text.encode())
        held = set(words)
        for item, passage, answer in zip(passages.ids, passages.words, passages.answers, strict=True):
            known = set(passage)
            if len(known & held) >= decontam.PARAPHRASE * len(known) and any(decontam.verify(words, first, size, passage, answer) for size in decontam.SIZES for first in range(0, len(words), decontam.STEP)):
                want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_marks_and_capitals_are_plain_pieces(tokenizer):
    """Each word's letters and marks are looked up for themselves, whatever ASCII marks and capitals they have; ids equal the library's."""
    rng = random.Random(8)
    heads = ["\u00c9queench", "\u00e9queench", "test", "TEST", "\u0130x", "\u1e9ea", "\u212ba", "\u212aa", "\u00d7a", "na\u00efve", "a'b", "x9"]
    made = [" ".join(rng.choice(heads) + "".join(rng.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u2026") for _ in range(rng.randint(0, 3))) for _ in range(20)) for _ in range(400)]
    made += ["a<|endoftext|>", "a<| endoftext|>b", "A<|startoftext|>$B$", "a$'s b$'t c'$s ***'re"]
    coder = bpe.WordIds(bpe.default_path())
    ids, at, _ = coder.encode(pa.array(made))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in tokenizer.encode_batch(made, add_special_tokens=False)]
    few = bpe.WordIds(bpe.default_path())
    few.encode(pa.array(["\u00c9queench \u00e9queench*** test$$$ TEST%"]))
    assert sorted(few.young.names.to_pylist()) == sorted(["\u00e9queench", "***", "test", "$$$", "%"])


def test_line_rules_read_few_texts_at_once(spark, tmp_path):
    """1000 rows of one Parquet file come in batches of at most 400, so that a task's memory doesn't hold 4096 texts; a session's smaller batches stay."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.createDataFrame([(i, f"Text {i} has a few words.\nAnd another line.") for i in range(1000)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    try:
        for asked, batches in ((None, 3), (100, 10)):
            spark.conf.unset(key) if asked is None else spark.conf.set(key, asked)
            out = quality.measure(spark.read.parquet(str(tmp_path / "docs")))
            assert len(out.collect()) == 1000
            todo, found = [out._jdf.queryExecution().executedPlan()], []
            while todo:
                plan = todo.pop()
                found += [plan.metrics().apply("numInputBatches").value()] if plan.nodeName() == "ColumnarToRow" else []
                todo += [plan.children().apply(i) for i in range(plan.children().size())]
            assert found == [batches]
    finally:
        spark.conf.unset(key)

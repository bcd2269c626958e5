"""The pipeline against plain Python that follows the same decisions, stage by stage."""

import numpy as np
import xxhash

import corpus_pipeline
from brute import removed_by_all_pairs
from quadloom.llm import bpe, decontam, langid
from quadloom.llm.common import documents, spool

SF = "/root/testdata/sf0.01"


def by_language(spark, rows):
    from pyspark.sql import functions as F

    docs = documents(spark.read.parquet(f"{SF}/documents.parquet"), "lang")
    filters = langid.train(docs.filter(langid.bucket(F.col("doc_id"), 4) != 2))
    least = langid.cuts(filters, docs.filter(langid.bucket(F.col("doc_id"), 4) == 2))
    decided = {d: filters.decide([t.encode()]) for d, t in rows.items()}
    return {d: t for d, t in rows.items() if any(c.isalpha() for c in t) and decided[d][2][0] >= least[decided[d][0][0]]}


def by_lines(rows):
    """What is left if every two documents that share a line are aligned."""
    out = {}
    for doc, gone in removed_by_all_pairs(rows).items():
        left = "\n".join(x for j, x in enumerate(rows[doc].split("\n")) if j not in gone)
        if not gone or left.encode().split():
            out[doc] = left
    return out


def by_fingerprint(rows):
    def fingerprint(text):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        bits = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                bits[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))

    ids = sorted(rows)
    prints = np.array([fingerprint(rows[d]) for d in ids], np.uint64)
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        for i in range(len(ids)):
            label[i] = label[np.bitwise_count(prints ^ prints[i]) <= 2].min()
        if (before == label).all():
            return {d: rows[d] for i, d in enumerate(ids) if label[i] == i}


def by_benchmark(rows, items):
    grams = lambda t: {tuple(w) for w in zip(*[decontam.tokens(t.encode())[k:] for k in range(5)], strict=False)}
    known = [g for g in map(grams, items) if g]
    return {d: t for d, t in rows.items() if not any(len(g & own) >= 0.8 * len(g) for own in [grams(t)] for g in known)}


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    brute = {"language_id": lambda x: by_language(spark, x), "line_dedup": by_lines, "near_dedup": by_fingerprint, "decontamination": lambda x: by_benchmark(x, items)}
    assert [n for n, _ in corpus_pipeline.STAGES] == [*brute, "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, want = spool(stage(spark, docs, SF), name), brute[name](rows)
        rows = {r.doc_id: r.text for r in docs.collect()}
        # Aligning fewer pairs leaves a line here and there; every other stage does just what plain Python does.
        different = [d for d in {*rows, *want} if rows.get(d) != want.get(d)]
        assert docs.columns == columns and len(different) <= (0.01 * len(want) if name == "line_dedup" else 0), name
        assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    tokenizer = Tokenizer.from_file(bpe.default_path())
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows.items()}
    run = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start"]
    assert run.sort_values(key).reset_index(drop=True).equals(packed.sort_values(key).reset_index(drop=True))


def test_decontamination_fits_on_all_documents_of_the_stage_before(spark, monkeypatch):
    """Every document that comes in counts for the model, whatever its id: none is sampled by it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null")
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1_000_000))
    found, fit = [], decontam.latent_basis
    monkeypatch.setattr(decontam, "latent_basis", lambda *a: found.append(fit(*a)) or found[-1])
    kept = [sorted(r.text for r in corpus_pipeline.decontaminate(spark, docs.withColumn("doc_id", docs.doc_id * 3 + shift), SF).collect()) for shift in (0, 1)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
    assert len(found) == 2 and (found[0] == found[1]).all()


def test_language_model_and_cuts_come_from_all_documents(spark):
    """A word that three of 9000 documents hold is known, and other ids of the same texts give the same model and cuts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = [f"these words stand in every text {letters[i % 26]}{letters[i // 26 % 26]}" + " and more of them" * (i % 7) for i in range(9000)]
    rare = ["".join(letters[(i // 3 * 7 + k * k) % 26] + "éüøçñ"[i // 3 // 26 % 5] for k in range(5)) for i in range(390)]
    texts = [f"{t} {rare[i]}" if i < len(rare) else t for i, t in enumerate(common)]
    found = []
    for shift in (0, 7_000_000):
        docs = spark.createDataFrame([(i + shift, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
        held = spark.createDataFrame([(i + shift, t + " qx" * (i % 11), "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
        filters = langid.train(docs)
        found.append((filters, langid.cuts(filters, held)))
    assert (found[0][0].table == found[1][0].table).all() and (found[0][1] == found[1][1]).all()
    assert min(found[0][0].decide([w.encode() for w in rare])[2]) > 0.9
    known = found[0][0].decide([(t + " qx" * (i % 11)).encode() for i, t in enumerate(texts)])[2]
    assert abs(found[0][1][0] - langid.CUT * np.median(known)) < 1 / langid.CUT_STEPS

"""Every operator and every pipeline stage on nulls, empty texts and tables, repeats, ties and clashing columns."""

import pytest

from quadloom.llm import decontam, langid, linedup, packing, quality, simhash, substring, toxicity, wavelet, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard long, n_words long, gone string, starts string, score double, hash string, n_removed long"
WORDS = " ".join(f"word{i}" for i in range(70))
LONG = "\n".join(f"line number {i} of a very long text." for i in range(8000))
TEXTS = [None, "", " \n\t ", "12345 !!!", "one", WORDS, WORDS, "a b " + WORDS, LONG, "Ünïcödé wörds, zwölf Boxkämpfer. " * 3, "x" * 100_000, "<|endoftext|> a", "a\x0bb\x0cc\r\nd", " 　"]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 1, 2, 3, "g", "s", 0.5, "h", 9) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)]
    return _docs(spark, [*rows, rows[5], (None, WORDS, "en"), (None, None, None), (3_000_000_000, "ties ties ties", "de")])


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(len(TEXTS))] + [(5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, " ".join(WORDS.split()[10:40])), (0, " ".join(WORDS.split()[10:40])), (1, None), (2, ""), (None, "x y z"), (3, "never found anywhere at all in these texts")], "item_id long, text string")


N = len(TEXTS)


def test_wavelet(odd, none):
    rows = {(r.doc_id, r.n_tokens) for r in wavelet.round_trip(odd).collect()}
    assert len([r for r in wavelet.round_trip(odd).collect()]) == N + 2 and {(0, 1), (1, 1), (2, 1)} <= rows
    assert wavelet.round_trip(none).count() == 0


def test_quality(odd, none):
    rows = quality.measure(odd).collect()
    assert len(rows) == N + 4
    first = rows[0]
    assert (first.n_words, first.n_symbols, first.n_dup_lines, first.n_repeat_words, first.base_failed, first.kept) == (0, 0, 0, 0, True, False)
    assert quality.measure(none).count() == 0 and quality.clean(odd).columns == ["doc_id", "text"]


def test_language(spark, odd, none):
    rows = langid.predict(odd).collect()
    assert len(rows) == N + 4 and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(none).count() == 0
    assert langid.train(none) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.keep_known(odd, None, None).columns == odd.columns and langid.keep_known(odd, None, None).count() == 0
    strange = _docs(spark, [(i, t, "en") for i, t in enumerate(["\u00bd \u00b2", "\u2460", "\u2160 12", "\u00aa", "a"])])
    assert [r.lang_pred for r in sorted(langid.predict(strange.unionByName(_docs(spark, [(50 + i, WORDS, "en") for i in range(9)]))).collect()) if r.doc_id < 5] == ["und", "und", "und", "en", "en"]
    filters = langid.train(odd)
    assert langid.cuts(None, odd) is None and (langid.cuts(filters, none) == langid.CUT).all() and len(langid.cuts(filters, odd)) == len(filters.languages)


def test_wordpiece(odd, none):
    rows = wordpiece.count_tokens(odd).collect()
    assert len(rows) == N + 4 and all(r.n_tokens >= r.n_words for r in rows) and rows[0].n_tokens == 0
    assert wordpiece.count_tokens(none).count() == 0


def test_line_dedup(odd, none):
    rows = {}
    for r in linedup.remove_lines(odd).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == N + 4
    assert rows[0][0].text is None and rows[0][0].n_lines == 0
    assert rows[5][0].n_removed == 0 and rows[6][0].text == "" and rows[6][0].n_removed == 1 and rows[7][0].n_removed == 0
    assert [r.text for r in rows[None] if r.text] == [WORDS]
    assert linedup.remove_lines(none).count() == 0 and set(linedup.remove_lines(odd).columns) == {*odd.columns, "n_lines"}


def test_toxicity(odd, none, labels):
    rows = toxicity.predict(odd, labels).collect()
    assert len(rows) == N + 4 and all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert toxicity.predict(none, labels).count() == 0
    assert {r.score for r in toxicity.predict(odd, labels.limit(0)).collect()} == {0.0}


def test_near_duplicates(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == N + 4
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (0, 1, 2)} == {0} and by[0].fp == 0 and by[6].component_id == 5
    assert simhash.near_duplicates(none).count() == 0


def test_decontamination(odd, none, benchmark):
    rows = {(r.doc_id, r.item_id) for r in decontam.find_leaks(odd, benchmark).collect()}
    assert rows == {(5, 0), (6, 0), (7, 0)}
    assert decontam.find_leaks(none, benchmark).count() == 0 and decontam.find_leaks(odd, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["one two three"], [WORDS], [WORDS, "x", WORDS], ["", " ", None], ["...", " - "], [None]])
def test_decontamination_of_few_documents(spark, benchmark, texts):
    docs = _docs(spark, [(i, t, "en") for i, t in enumerate(texts)])
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()} == {(i, 0) for i, t in enumerate(texts) if t == WORDS}


def test_decontamination_does_not_depend_on_blocks(spark, odd, monkeypatch):
    """Rows that repeat a doc_id give one row, whether the items fill one block, several, or several passes."""
    items = [(0, " ".join(WORDS.split()[10:40])), (1, " ".join(WORDS.split()[40:60])), (2, "line number 7 of a very long text line number 8 of a very long text"), (3, "never found anywhere at all in these texts"), (4, "some other words that no text holds"), (5, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(odd, table).collect())
    assert len(want) == len(set(want)) and {(5, 0), (5, 1), (6, 0), (8, 2)} <= set(want)
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 2)
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(odd, table).collect()) == want
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 1)
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(odd, table).collect()) == want


def test_document_frequencies_of_many_short_texts(spark):
    """Memory follows the words: 200,000 three-word texts in one batch, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from quadloom.llm import decontam
class Rows:
    def mapInArrow(self, run, schema):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        out = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(200_000)), "text": [f"a{i} b{i % 99} a{i}" for i in range(200_000)]})])))
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10, sum(out[0].column(1).to_pylist()))
        raise SystemExit
decontam.document_frequencies(Rows())
"""
    grown, counted = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.split())
    assert grown < 300 and counted <= 600_000


def test_substring(odd, none):
    rows = [r for r in substring.remove_repeats(odd).collect()]
    assert len(rows) == N + 2
    by = {r.doc_id: r for r in rows}
    assert by[6].n_removed == 70 and by[7].n_removed == 70 and by[7].kept == "a b" and by[5].n_removed == 0 and by[0].kept == ""
    assert substring.remove_repeats(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd, with_ids=True).collect()
    assert {r.doc_id for r in rows} == {*range(N), 3_000_000_000}
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(none).count() == 0


def test_pipeline(spark, odd, none, benchmark, tmp_path_factory):
    import corpus_pipeline as pipeline
    from quadloom.llm.common import spool

    few = [_docs(spark, [(i, t, "en") for i, t in enumerate(texts)]) for texts in ([WORDS], ["", None], ["12 34", "."])]
    for docs in (odd, none, *few):
        sf = str(tmp_path_factory.mktemp("sf"))
        docs.write.parquet(f"{sf}/documents.parquet")
        benchmark.write.parquet(f"{sf}/benchmark.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in pipeline.STAGES[:-1]:
            before, now = now, spool(stage(spark, now, sf), name)
            assert now.columns == before.columns and now.count() <= before.count()
        assert pipeline.run(spark, sf).columns[0] == "doc_id"

"""Token counts by greedy word pieces, in one pass over each word and without building pieces.

The vocabulary is a trie of two roots (pieces that begin a word, pieces that go on). A node's
failure link leads to the node reached when the longest matched pieces are popped from its
string, and each node stores how many pieces that pops; so a word's number of pieces is a sum of
stored counts along a walk that never turns back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quadloom.llm.common import documents, regrouped, spans, tidy, tune

#: Counts kept by a worker; when full, the cache starts anew.
CACHE_WORDS = 600_000
#: A code point fits in so many bits.
_SHIFT = 21


class Automaton:
    def __init__(self, initial: list[str], later: list[str]) -> None:
        self.next: dict[int, int] = {}
        parent, letter, piece = [0, 0], [0, 0], [False, False]
        for root, pieces in ((0, initial), (1, later)):
            for text in pieces:
                if not text:
                    continue
                at = root
                for c in map(ord, text):
                    key = at << _SHIFT | c
                    if key not in self.next:
                        self.next[key] = len(parent)
                        parent.append(at)
                        letter.append(c)
                        piece.append(False)
                    at = self.next[key]
                piece[at] = True
        # Breadth first, so that links are known for all shorter strings.
        children: list[list[int]] = [[] for _ in parent]
        for node in range(2, len(parent)):
            children[parent[node]].append(node)
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        level = children[0] + children[1]
        while level:
            for node in level:
                if piece[node]:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, count = self.fail[parent[node]], self.popped[parent[node]]
                while at >= 0 and (at << _SHIFT | letter[node]) not in self.next:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at << _SHIFT | letter[node]], count
            level = [child for node in level for child in children[node]]

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be cut into pieces."""
        next_, fail, popped = self.next, self.fail, self.popped
        at, pieces = 0, 0
        for c in map(ord, word):
            while (to := next_.get(at << _SHIFT | c)) is None:
                pieces += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != 1:
            pieces += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return pieces


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word (the file marks them) and pieces that go on; no control or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p.startswith("▁")], [p for p in plain if "▁" not in p]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> tuple[Automaton, dict[str, int]]:
    return Automaton(*vocabulary(path)), {}


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    automaton, known = _counter(path)
    for batch in regrouped(batches):
        lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
        at = np.asarray(lists.offsets)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(known) + len(distinct) > CACHE_WORDS:
            known.clear()
        for word in distinct:
            if word not in known:
                known[word] = automaton.count(word)
        pieces = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        words = np.array([bool(w) for w in distinct], bool)
        code = coded.indices.to_numpy() if len(coded) else np.empty(0, np.int64)
        bounds = at - at[0]
        total = lambda each: np.diff(spans(each[code])[bounds])
        unknown = (pieces == 0) & words
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": total(words.astype(np.int64)), "n_tokens": total(pieces + unknown), "n_unknown": total(unknown.astype(np.int64))})


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per row: doc_id, n_words, n_tokens, n_unknown.

    Words are cut at ASCII white space. A word that pieces don't cover counts as one (unknown)
    token. A null text has no words: all counts 0. Repeated rows and null doc_ids stay as they
    are; an empty table gives no rows.
    """
    path = model or default_path()
    tune(docs.sparkSession)
    return documents(docs).mapInArrow(tidy(lambda it: _count(it, path)), "doc_id long, n_words long, n_tokens long, n_unknown long")

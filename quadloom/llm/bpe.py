"""Token ids by a public tokenizer, with a bounded cache of whole words.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its
words one after another (special-token strings hold no white space either). Each distinct word
is tokenized once per Python worker; a text then costs one dictionary lookup per word.

That holds for vocabulary files with the normalizer and the pre-tokenizer below. Any other file is
left to the library, text by text; sentence ends are not known then.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quadloom.llm.common import gather, spans

#: Words (without marks behind them) kept by a worker, in two halves: when the young half is full it becomes the old one,
#: and words met again move over from the old half that is dropped next.
CACHE_WORDS = 600_000
#: A word ends a sentence if it ends in one of these.
SENTENCE_END = "[.!?\u2026\u3002]$"
#: Small Latin letters, which no normalization changes, with marks behind them: one or two pre-tokens.
#: Marks are all of ASCII but the apostrophe, which the pre-tokenizer looks at, and < and |, of which special tokens are made.
LETTERS, MARKS = "[a-z\u00df-\u00f6\u00f8-\u00ff]+", "[!-&(-/:;=-@\\[-`{}~]+"
MARKED, PIECE = f"^({LETTERS})({MARKS})$", f"^({LETTERS}|{MARKS})$"
JOINED_WORDS = 300
#: What a file must say for texts to fall into words: lower case, and no pre-token across white space.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind whose texts fall into words."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [{}]
    return (
        [x.get("type") for x in normal.get("normalizers", [])] == NORMALIZERS
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": SPLIT} and bool(steps[0].get("invert"))
        and bool(spec["model"].get("end_of_word_suffix")) and all("<|" in t["content"] and not any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", []))
    )


def byte_level(text: str) -> str:
    """The vocabulary's letters for UTF-8 bytes, for plain pieces: Latin-1 but for three bytes."""
    return text.encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")


class Words:
    """Ids of some words in a row, and which words end a sentence."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.flat, self.starts, self.lengths, self.ends = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)

    def __len__(self) -> int:
        return len(self.names)

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 if it isn't here. One hash table a call is cheaper than a Python object a word."""
        return pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy().astype(np.int64)

    def add(self, words: pa.Array, flat: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, words])
        self.starts = np.concatenate([self.starts, len(self.flat) + spans(lengths)[:-1]])
        kind = np.uint16 if self.flat.dtype == np.uint16 and (not len(flat) or flat.max() < 1 << 16) else np.uint32
        self.flat = np.concatenate([self.flat.astype(kind, copy=False), flat.astype(kind)])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.ends = np.concatenate([self.ends, ends])


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are known to be single pre-tokens: many of them in one call.
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = by_words(spec)
        if not self.by_words:
            return
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.joined = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = spec["model"]["end_of_word_suffix"]
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.young, self.old = Words(), Words()

    def _tokenize(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the pieces (plain ones first), their ids in a row and how many each has."""
        plain = pc.match_substring_regex(new, PIECE).to_numpy(zero_copy_only=False)
        flats, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        parts = new.filter(pa.array(plain)).to_pylist()
        for i in range(0, len(parts), JOINED_WORDS):
            # A plain piece is one pre-token, so exactly its last id ends a word.
            ids = np.array(self.joined.encode_batch_fast([byte_level(" ".join(parts[i : i + JOINED_WORDS]))], add_special_tokens=False)[0].ids, np.int64)
            flats.append(ids)
            lengths.append(np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1))
        if others := new.filter(pa.array(~plain)).to_pylist():
            each = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            flats.append(np.array([i for ids in each for i in ids], np.int64))
            lengths.append(np.array(list(map(len, each)), np.int64))
        return np.argsort(~plain, kind="stable"), np.concatenate(flats), np.concatenate(lengths)

    def _codes(self, distinct: pa.Array) -> np.ndarray:
        """Places in self.young of distinct pieces."""
        distinct = distinct.cast(pa.large_string())
        if len(self.young) + len(distinct) > CACHE_WORDS // 2 and len(self.young):
            self.young, self.old = Words(), self.young
        found = self.young.find(distinct)
        if (absent := np.flatnonzero(found < 0)).size:
            before = self.old.find(distinct.take(pa.array(absent)))
            again, at = absent[before >= 0], before[before >= 0]
            if len(again):
                lengths = self.old.lengths[at].astype(np.int64)
                found[again] = len(self.young) + np.arange(len(again))
                self.young.add(distinct.take(pa.array(again)), gather(self.old.flat, self.old.starts[at], lengths), lengths, self.old.ends[at])
            if (fresh := absent[before < 0]).size:
                words = distinct.take(pa.array(fresh))
                order, flat, lengths = self._tokenize(words)
                found[fresh[order]] = len(self.young) + np.arange(len(fresh))
                self.young.add(words.take(pa.array(order)), flat, lengths, pc.match_substring_regex(words, SENTENCE_END).to_numpy(zero_copy_only=False)[order])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, the offsets of each text among them, and the offsets just behind sentence ends. Nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_words:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(each), np.uint32), spans(np.fromiter(map(len, each), np.int64, len(each))), np.empty(0, np.int64)
        # The tokenizer lower-cases; special tokens, which it looks for first, hold "<|".
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        at = np.asarray(lists.offsets)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        if not len(coded):
            return np.empty(0, np.uint32), at - at[0], np.empty(0, np.int64)
        # A word of letters and marks is looked up as two pieces, so that its letters are met again.
        lower = pc.utf8_lower(coded.dictionary)
        # Dotted capital I is the one letter whose full lower case differs from the simple one.
        same = pc.invert(pc.match_substring(coded.dictionary, "\u0130"))
        marked = pc.and_(pc.match_substring_regex(lower, MARKED), same)
        # Letters alone are looked up in lower case, so that they are met again and tokenized with other plain pieces.
        letters = pc.and_(pc.match_substring_regex(lower, f"^{LETTERS}$"), same)
        pieces = pc.ascii_split_whitespace(pc.if_else(letters, lower, pc.if_else(marked, pc.replace_substring_regex(lower, MARKED, r"\1 \2"), coded.dictionary)))
        piece = pieces.values.dictionary_encode()
        first = np.asarray(pieces.offsets).astype(np.int64)
        word = coded.indices.to_numpy()
        count = np.diff(first)[word]
        codes = gather(self._codes(piece.dictionary)[piece.indices.to_numpy()], first[word], count)
        lengths = self.young.lengths[codes].astype(np.int64)
        behind = spans(lengths)
        ids = gather(self.young.flat, self.young.starts[codes], lengths).astype(np.uint32)
        return ids, behind[spans(count)][at - at[0]], behind[1:][self.young.ends[codes]]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary file."""
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

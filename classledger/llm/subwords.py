"""Subword ids of whole texts, word by word, for tokenizers whose tokens never span ASCII white space.

Distinct words are encoded once and kept; a text's ids are gathered from the
kept ones as numpy arrays.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd

from .tables import tokenizer_path
from .words import SEPARATORS, Words, hash_runs, split_words

CACHED_WORDS = 1_000_000
_SEPARATOR, _LETTER, _DIGIT, _PUNCTUATION, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(SEPARATORS)] = _SEPARATOR
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")] = _PUNCTUATION
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOWER_CASE = np.arange(256, dtype=np.uint8)
_LOWER_CASE[65:91] += 32


class Subwords:
    """Ids of texts, each text closed by ``end``; ``encode_words`` gives all words' ids and how many each has."""

    def __init__(self, end: int):
        self.end = end
        self._forget()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # words' hashes in order, and their slots
        self.flat = np.asarray([self.end], np.uint32)
        self.start, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)  # of a slot's ids; slot 0 is the end mark

    def _learn(self, place: np.ndarray, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """The slots of new words, whose hashes belong at these places of ``self.keys``."""
        ids, length = self.encode_words(words)
        slots = np.arange(len(self.start), len(self.start) + len(keys))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(length) - length)
        self.length, self.flat = np.append(self.length, length), np.concatenate([self.flat, ids])
        order = np.argsort(keys)
        self.keys = np.insert(self.keys, place[order], keys[order])
        self.slot = np.insert(self.slot, place[order], slots[order])
        return slots

    def __call__(self, words: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins, distinct words' hashes, each word's number among them).

        ``lower``: A-Z are lower-cased first, as the words' hashes then are.
        """
        back, unique = pd.factorize(words.hash)
        at = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))  # numbered as they first occur
        if len(self.keys) + len(unique) > CACHED_WORDS:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        inside = place < len(self.keys)
        known = inside.copy()
        known[inside] = self.keys[place[inside]] == unique[inside]
        slot = np.empty(len(unique), np.int64)
        slot[known] = self.slot[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.data.tobytes()
            raw = raw.lower() if lower else raw  # bytes.lower(): A-Z only
            spans = zip(words.start[at[new]].tolist(), words.end[at[new]].tolist())
            slot[new] = self._learn(place[new], unique[new], [raw[a:b].decode() for a, b in spans])
        slots = np.zeros(len(words.hash) + words.texts, np.int64)
        owner = np.repeat(np.arange(words.texts), words.counts())
        slots[np.arange(len(owner)) + owner] = slot[back]
        length = self.length[slots]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(self.start[slots] - (ends - length), length) + np.arange(ends[-1])]
        return flat, np.append(0, ends[words.first[1:] + np.arange(words.texts)]), unique, back


def _ragged(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))


class PieceIds(Subwords):
    """Ids by a sentencepiece model, each word on its own; the end mark is the first id past the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__(self.model.get_piece_size())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _ragged(self.model.encode(words, num_threads=1))


def split_parts(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The parts that the splitter of ``word_bpe_49k.json`` makes of words, as ``Words``.

    A word of ASCII and Latin-1 letters, digits and common punctuation falls
    into runs of letters, runs of punctuation and single digits, lower-cased
    here as the normaliser does it. Any other word (apostrophes, ``<`` and
    ``>`` of special strings, other scripts) is one part, as it is.
    """
    words = split_words(data, offsets)
    if not len(words.start):
        return words
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    text = _LOWER_CASE[data]
    capital = lead[data[lead + 1] < 0x9F] + 1
    text[capital] = data[capital] + 0x20
    others = np.append(0, np.cumsum(kind == _OTHER))
    odd = others[words.end] > others[words.start]
    length = (words.end - words.start)[odd]
    places = np.repeat(words.start[odd] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    text[places] = data[places]
    kind[places] = _OTHER
    begins = kind == _DIGIT
    begins[1:] |= kind[1:] != kind[:-1]
    begins &= kind != _SEPARATOR
    begins[words.start] = True
    start = np.flatnonzero(begins)
    word = np.cumsum(np.bincount(np.searchsorted(start, words.start), minlength=len(start))) - 1
    end = np.minimum(np.append(start[1:], len(data)), words.end[word])
    return Words(text, offsets, np.searchsorted(start, offsets), hash_runs(text, start), start, end)


class WordIds(Subwords):
    """Ids as the library gives them for ``word_bpe_49k.json``, special strings inside texts included.

    The file's normaliser and splitter treat white space as a separator only,
    and ``split_parts`` does their work for most words. Runs of letters then
    go through the merges alone, many in one string: the model's word end is
    one more symbol there, whose merges with the last characters come first,
    and no merge passes over it. All other parts go through the whole library.
    """

    LETTERS = re.compile("[a-zß-öø-ÿ]+")
    WORD_END = "\ue000"
    TOGETHER = 200

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix, pairs = model["end_of_word_suffix"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(left.endswith(suffix) for left, _ in pairs):
            raise ValueError("a merge passes over a word's end; words can't be encoded together")
        mark = lambda t: t[:-len(suffix)] + self.WORD_END if t.endswith(suffix) else t
        vocabulary = {mark(t): i for t, i in model["vocab"].items()}
        vocabulary.setdefault(self.WORD_END, max(vocabulary.values()) + 1)
        last = [(t[0], self.WORD_END) for t in vocabulary if len(t) == 2 and t.endswith(self.WORD_END)]
        self.merges = Tokenizer(BPE(vocab=vocabulary, merges=last + [(mark(a), mark(b)) for a, b in pairs]))
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        super().__init__(end)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``words``: parts as ``split_parts`` gives them."""
        letters = np.fromiter((self.LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
        plain = [w for w, yes in zip(words, letters) if yes]
        joined = [(self.WORD_END.join(plain[i:i + self.TOGETHER]) + self.WORD_END)
                  for i in range(0, len(plain), self.TOGETHER)]
        shown = [w if w.isascii() else self.WORD_END.join(
            x.encode().decode("latin-1").translate(self.visible) for x in w.split(self.WORD_END)) for w in joined]
        several = [np.asarray(e.ids, np.uint32) for e in self.merges.encode_batch_fast(shown, add_special_tokens=False)]
        merged = np.concatenate([np.zeros(0, np.uint32), *several])
        merged_lengths = np.diff(np.append(-1, np.flatnonzero(self.ends_word[merged])))
        rest = [w for w, yes in zip(words, letters) if not yes]
        other, other_lengths = _ragged([e.ids for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)])
        length = np.empty(len(words), np.int64)
        length[letters], length[~letters] = merged_lengths, other_lengths
        from_merges = np.repeat(letters, length)
        ids = np.empty(len(from_merges), np.uint32)
        ids[from_merges], ids[~from_merges] = merged, other
        return ids, length


_known: dict[tuple, Subwords] = {}


def piece_ids(tokenizer: str) -> PieceIds:
    """One table for each worker process."""
    key = (PieceIds, tokenizer)
    if key not in _known:
        _known[key] = PieceIds(tokenizer_path(tokenizer))
    return _known[key]


def word_ids(tokenizer: str, end: int) -> WordIds:
    """One table for each worker process."""
    key = (WordIds, tokenizer, end)
    if key not in _known:
        _known[key] = WordIds(tokenizer_path(tokenizer), end)
    return _known[key]

"""Token ids by a tokenizers file, with a table of words."""

from __future__ import annotations

import os
import re
import sys
from types import ModuleType

import numpy as np

from .hashing import SpanHasher

#: Texts of these characters only are cut into words here; any other text goes to the tokenizer whole.
#: Left out are characters on which Unicode versions, case rules or composition could differ.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž–—‘-”…]*")

_BLANK, _LETTER, _DIGIT, _SYMBOL, _INNER = 0, 1, 2, 3, 4
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 13, 32]] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[range(48, 58)] = _DIGIT
_CLASS[range(0x80, 0xC0)] = _INNER


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lower-case plain text: contractions, runs of letters, digits, runs of symbols."""
    kind = _CLASS[data]
    for _ in range(2):  # the later bytes of a character take its class
        inner = np.flatnonzero(kind == _INNER)
        kind[inner] = kind[inner - 1]
    before = np.concatenate([[_BLANK], kind[:-1]]).astype(np.uint8)
    first = (kind != before) | ((kind == _DIGIT) & (data < 128))
    first &= kind != _BLANK
    quote = np.flatnonzero(first & (data == 0x27))
    if len(quote):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        at, size = quote[one | two], np.where(one, 2, 3)[one | two]
        first[at + 1] = False
        after = at + size
        inside = after[after < len(data)]
        first[inside[kind[inside] == _LETTER]] = True
    start = np.flatnonzero(first)
    stop = np.flatnonzero(first | ((kind == _BLANK) & (before != _BLANK)))
    return start, np.append(stop, len(data))[np.searchsorted(stop, start, "right")]


class WordBpe:
    """Ids of whole texts, as tokenizers gives them for a lower-casing BPE with word ends, which never joins two words.

    In such a vocabulary a word's ids do not depend on its neighbours, so a distinct word is encoded once and found
    again by its 64-bit hash, in a table of SLOTS places. The first word of a place keeps it, as common words come early;
    another is encoded whenever it comes. At most about max_words are remembered.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str, max_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are in lower case and cut already, with a space between them.
        self.cut_words = Tokenizer(self.tokenizer.model)
        self.cut_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for s, i in vocabulary.items() if s.endswith(suffix)]] = True
        #: Texts with one of these strings, in any case, go to the tokenizer whole.
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        self.max_words, self.hasher = max_words, SpanHasher()
        self._reset()

    def _reset(self) -> None:
        # Of a place: its word's hash and number, no word at first. Of a word: its ids are flat[cuts[word] : cuts[word + 1]].
        self.held, self.word = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.flat, self.cuts = np.empty(0, np.uint32), np.zeros(1, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array of ids for each text."""
        plain = [bool(_PLAIN.fullmatch(t)) and not self.special.search(t) for t in texts]
        raw = [t.lower().encode() if p else b"" for t, p in zip(texts, plain, strict=True)]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        start, stop = word_starts(data)
        word = self._numbers(self.hasher.spans(self.hasher.sums(data), start, stop), data, start, stop)
        first = self.cuts[word]
        size = self.cuts[word + 1] - first
        total = np.cumsum(size)
        ids = self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + size, size)]
        cuts = np.concatenate([[0], total])[np.concatenate([[0], np.searchsorted(start, ends)])]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        other = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(other, self.tokenizer.encode_batch_fast([texts[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def _numbers(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The words' numbers; words that the table does not hold are encoded and join it."""
        if len(self.cuts) > self.max_words:
            self._reset()
        place = (key & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.word[place]
        missed = np.flatnonzero((self.held[place] != key) | (out < 0))
        if len(missed):
            each, at, back = np.unique(key[missed], return_index=True, return_inverse=True)
            at = missed[at]
            raw = data.tobytes()
            strings = [raw[a:b].decode() for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
            coded = self.cut_words.encode_batch_fast([" ".join(strings[k : k + 500]) for k in range(0, len(strings), 500)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(strings):
                raise ValueError("the tokenizer does not end every word")
            number = np.arange(len(each), dtype=np.int32) + np.int32(len(self.cuts) - 1)
            self.cuts = np.concatenate([self.cuts, (ends + len(self.flat)).astype(np.int32)])
            self.flat = np.concatenate([self.flat, ids])
            empty = self.word[place[at]] < 0
            to = place[at[empty]]
            self.held[to], self.word[to] = each[empty], number[empty]  # of new words that share a place the last one gets it
            out[missed] = number[back]
        return out


def _kept() -> dict[str, WordBpe]:
    # This package travels with each task's code, so its own variables last for a task; what Python has imported lasts as long as the worker.
    return sys.modules.setdefault("_lodestone_tokenizers", ModuleType("_lodestone_tokenizers")).__dict__.setdefault("kept", {})


def kept_bpe(path: str) -> WordBpe:
    """The tokenizer of a path with the words of earlier tasks of this worker, until forget()."""
    if path not in (kept := _kept()):
        kept.clear()
        kept[path] = WordBpe(path)
    return kept[path]


def forget() -> None:
    """Drop what kept_bpe() keeps: for tasks of later stages, which need the memory."""
    _kept().clear()

"""Ids of the lower-case word BPE, word by word, as the tokenizers library gives them.

The vocabulary drops white space and never merges across it, so a text's ids
are those of its white-space separated words in a row; each worker keeps the
ids of the words it has met.  A text with characters for which that has not
been shown (special-token strings, separators the two libraries see
differently, letters with context-bound or newer case rules) goes through the
library whole.
"""

from __future__ import annotations

import functools
import json
import re

#: Words whose ids a worker keeps; beyond it the store starts anew.
CACHE_WORDS = 300_000
#: Characters that are turned into ids at a time, cut at white space.
SLICE_CHARS = 1 << 20

_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\u024f\\u0370-\\u0373\\u0375-\\u03a2\\u03a4-\\u0482\\u048a-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*")
#: Letters, then marks that start no contraction: the vocabulary never merges the two.
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)")
_BREAK = re.compile(r"[ \t\n\r]")


#: The byte-level alphabet: printable Latin-1 characters stand for their own
#: bytes, the other bytes for the characters from 256 on, in order.
_OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}


class _Words(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class WordBpe:
    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self._np = np
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec.update(normalizer=None, pre_tokenizer=None, added_tokens=[])
        self._model = Tokenizer.from_str(json.dumps(spec)).model  # the same merges, without the text steps
        self._words = _Words(self._word)

    def _pack(self, ids) -> bytes:
        return self._np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            seen = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
            return self._pack([t.id for t in self._model.tokenize(seen)])
        cut = _LETTERS_MARKS.fullmatch(word)
        if cut:
            return self._words[cut[1]] + self._words[cut[2]]
        return self._pack(self.full.encode(word, add_special_tokens=False).ids)

    def parts(self, text: str):
        """The ids of a text as little-endian unsigned 32-bit bytes, part by part."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            yield self._pack(self.full.encode(text, add_special_tokens=False).ids)
            return
        at = 0
        while at < len(text):
            end = at + SLICE_CHARS
            if end < len(text):
                cut = _BREAK.search(text, end)
                end = cut.start() if cut else len(text)
            yield b"".join(map(self._words.__getitem__, text[at:end].lower().split()))
            at = end


@functools.cache
def load(path: str) -> WordBpe:
    return WordBpe(path)

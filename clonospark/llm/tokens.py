"""Token ids of whole texts from a public vocabulary file, with a bounded word memory."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Characters for which this module's splitting equals the vocabulary file's: Latin letters up to U+017F,
#: but U+0130, whose lower case is two characters.
_PLAIN = [chr(c) for c in range(0x180) if c != 0x130]
_KIND = {x: unicodedata.category(x)[0] for x in _PLAIN}
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _cls(chars) -> str:
    return "".join(re.escape(x) for x in chars)


_LETTER = _cls(x for x in _PLAIN if _KIND[x] == "L")
_DIGIT = _cls(x for x in _PLAIN if _KIND[x] == "N")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{re.escape(_SPACE)}{_LETTER}{_DIGIT}]+")
_ODD = re.compile("[^\\x00-\\u012f\\u0131-\\u017f]")

# The vocabulary spells bytes as characters: those outside these ranges as code points from 256 on (fixed values).
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OWN)}


def _plain(text: str) -> bool:
    """Whether this module splits ``text`` as the vocabulary file does.

    Every plain character is its own composed form and none combines, so plain texts are normalised already.
    """
    if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.search(text)
    return True


def word_vocabulary() -> str:
    """The default vocabulary's file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCodec:
    """Little-endian 16-bit ids of a text under a lower-casing word vocabulary.

    Texts split into words before any merge, so a word's ids never depend on its
    neighbours. Words are encoded once, by the library's merge model alone, and kept, up to ``most`` words; then the memory
    starts anew. Texts with characters outside the plain range, and those that hold a
    special token's opening, go to the tokenizers library whole.
    """

    _one: dict[str, WordCodec] = {}

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.merge = self.tokenizer.model.tokenize
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")

    @classmethod
    def of(cls, path: str) -> WordCodec:
        """One per Python worker and file."""
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _miss(self, chunk: str) -> bytes:
        known, ids = self.known, []
        for w in _SPLIT.findall(chunk):
            if (got := known.get(w)) is None:
                spelt = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_SPELT)
                got = np.asarray([t.id for t in self.merge(spelt)], "<u2").tobytes()
                if len(w) <= 64:
                    known[w] = got
            ids.append(got)
        got = b"".join(ids)
        if len(chunk) <= 64:
            known[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if not _plain(text):
            return self._whole(text)
        known, miss = self.known, self._miss
        if len(known) > self.most:
            known.clear()
        return b"".join([known.get(c) or miss(c) for c in text.lower().split()])

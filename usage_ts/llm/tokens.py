"""Token ids of whole texts with a word-level byte-pair vocabulary, word by word.

The vocabulary's rules (canonical composition, white space dropped, lower case, split at letters,
digits and signs) never look across white space, so equal words have equal ids. Each worker keeps the
ids of words it has met; the memory of that table is bounded, and what it holds never changes a result.
"""

from __future__ import annotations

from functools import lru_cache
from array import array

import regex
from tokenizers import Tokenizer

#: Words whose ids a worker keeps.
KEPT_WORDS = 600_000
_WORD = regex.compile(r"[^ \t-\r]+")
#: White space to ``str.split`` that does not end a word here.
_ODD = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of plain letters, digits and signs; others go through the library's own normalisers.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-įı-ʯ]+")
#: Fixed value: the vocabulary's split rule.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """``ids(text)``: little-endian unsigned 32-bit ids of a text."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha()):
            if "<|" in word or not _PLAIN.fullmatch(word):
                return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            body, sign = word[:-1], word[-1]
            if not word.isalpha() and not (body.isalpha() and sign in ".,;:!?"):
                return b"".join(map(self._piece, _PIECE.findall(word.lower())))
            if not word.isalpha():
                return (self.kept.get(body) or self._piece(body.lower())) + self._piece(sign)
        return self._piece(word.lower())

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        # Without odd separators the plain split finds the same words, faster.
        words = _WORD.findall(text) if _ODD.search(text) else text.split()
        for word in set(words).difference(kept):
            kept[word] = self._word(word)
        return b"".join(map(kept.__getitem__, words))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)

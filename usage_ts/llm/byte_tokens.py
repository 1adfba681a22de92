"""Token ids of whole texts with a byte-level byte-pair vocabulary, whose ids follow the order of its merges."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from usage_ts.llm.tokens import _byte_letters

#: Fixed value: the vocabulary's split rule.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose kind is the same in every edition of Unicode, for both libraries.
_SETTLED = re.compile(r"[\x00-\x1b -\x7e\xa0-ɏ]*")
#: Longer stretches without or of white space go through the library itself.
LONG = 4096
_SPACES = re.compile(r"\s{%d}" % LONG)


class ByteTokens:
    """``ids(text)``: little-endian unsigned 32-bit ids of a text, equal to the tokenizer file's own."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.added}
        self.fast = tiktoken.Encoding("ranks", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})

    def _settled(self, text: str) -> bool:
        return (
            _SETTLED.fullmatch(text) is not None
            and not any(a in text for a in self.added)
            and max(map(len, text.split()), default=0) < LONG
            and not _SPACES.search(text)
        )

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._settled(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)

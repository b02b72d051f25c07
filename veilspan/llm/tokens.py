"""Token ids of the public word-level BPE, fast: what stands between white space is encoded once and looked up afterwards.

The tokenizer splits a lower-cased text into words before its merges, never across white space, so a text's ids are
those of its pieces between white space in a row. Texts with anything unusual (special-token strings, characters outside Latin and general punctuation) take
the tokenizer's own path; the tests hold both against each other.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import worker_cache

VOCABULARY = "word_bpe_49k.json"
END_ID = 1

_PLAIN = re.compile("[^\t\n\v\f\r -~¡-ɏ]")
_CACHE_TOKENS = 400_000
#: Marks of tokens seen once. Most tokens of a corpus occur once; only what comes again is kept in the table.
_MARKS = 1 << 22


class WordEncoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes, without special tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.known: dict[str, bytes] = worker_cache(f"tokens {path}")
        self.seen = bytearray(_MARKS)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or _PLAIN.search(text):
            return self._whole(text)
        given, known = text.lower().split(), self.known
        try:
            return b"".join(map(known.__getitem__, given))
        except KeyError:
            pass
        if len(known) > _CACHE_TOKENS:
            known.clear()
            self.seen = bytearray(_MARKS)
        new = [w for w in dict.fromkeys(given) if w not in known]
        parts = [self.split(w) for w in new]
        fresh = [w for w in dict.fromkeys(chain.from_iterable(parts)) if w not in known]
        if fresh:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, dtype="<u4")
            packed, start = ids.tobytes(), 0
            for w, end in zip(fresh, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                known[w] = packed[start:end]
                start = end
        for w, words in zip(new, parts, strict=True):
            if len(words) > 1:
                known[w] = b"".join(map(known.__getitem__, words))
        out, seen = b"".join(map(known.__getitem__, given)), self.seen
        for w in dict.fromkeys(chain(new, fresh)):
            mark = hash(w) % _MARKS
            if not seen[mark]:
                seen[mark] = 1
                del known[w]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def encoder(path: str) -> WordEncoder:
    """One encoder in each Python worker."""
    enc = _encoder(path)
    worker_cache(f"tokens {path}")
    return enc


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)

"""Token ids of whole texts, word by word, inside Arrow tasks.

A word (a match of the public pattern) always has the same ids, so a task remembers the words it
has met, within a bound, and only new ones go through the merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

# Words that one task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

# Letters, numbers and white space among the first 256 code points, as the public
# pattern's classes \p{L}, \p{N} and \s see them.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
SPACES = "\\t-\\r \\x85\\xa0"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Split a text into the matches of ``pattern``; texts within Latin-1 take a faster engine."""
    import regex

    full = regex.compile(pattern)
    near = re.compile(
        pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]")
        .replace("\\p{L}", f"[{LETTERS}]").replace("\\p{N}", f"[{NUMBERS}]")
        .replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]")
    )

    def split(text: str) -> list[str]:
        return near.findall(text) if not text or max(text) <= "\xff" else full.findall(text)

    return split


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for.

    Printable bytes stand for themselves; the others follow from code point 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def word_encoder(vocabulary: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of one word, by the vocabulary file of the tokenizers library; ids are merge ranks."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    of = byte_of_char()
    ranks = {bytes(map(of.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in of for c in t)}
    top = len(ranks)
    ranks = {t: i for t, i in ranks.items() if i < top}
    encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, and their number."""

    def __init__(self, vocabulary: str, pattern: str):
        self.split, self.encode_word = splitter(pattern), word_encoder(vocabulary, pattern)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        words = self.split(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = np.asarray(self.encode_word(word), dtype="<u4").tobytes()
            return b"".join(map(known.__getitem__, words))

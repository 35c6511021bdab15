"""Tokens, words and hashes shared by the text operators."""

from __future__ import annotations

import re

import numpy as np

#: The public WordPunct pattern; ``\w`` holds Unicode letters and digits.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words of the overlap rules: maximal runs of a-z and 0-9 in lower-cased text.
WORD = re.compile(r"[a-z0-9]+")


def count_tokens(text: str) -> int:
    """Tokens of ``text`` without keeping them."""
    return sum(1 for _ in TOKEN.finditer(text))


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash per word, the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))

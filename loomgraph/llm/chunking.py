"""Splitting oversized texts at natural boundaries, content-defined.

Token hashes pass a rolling window; a landmark is a token where the window's hash is a
multiple of ``every``. A cut takes the landmark of smallest hash between the least and
the greatest piece length and snaps to the nearest natural boundary in that range,
boundaries of a higher kind first (blank line, line break, end of sentence, clause).
Both depend only on nearby text, so an edit moves the cuts around it and the later ones
fall back into place. Every piece but the first starts with the last ``overlap`` tokens
of the piece before it.

Texts that cannot be over the limit are removed by the scan's own filter (a text has no
more tokens than characters); the rest are split in one pass, one document at a time,
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import TOKEN

WINDOW = 12
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_ENDS = re.compile(r"[.!?…。！？]+[\"'”’)\]]*$")
_PAUSES = re.compile(r"[,;:]+$")


def _rolling(hashes: np.ndarray) -> np.ndarray:
    """Hash of the window that ends before each token; 0-padded at the start."""
    base = np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([np.zeros(WINDOW, dtype=np.uint64), hashes])
    out = np.zeros(len(hashes), dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW + 1):
            out += padded[WINDOW - back : WINDOW - back + len(hashes)] * power
            power *= base
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def boundary_kinds(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, how natural a cut before it is: 4 blank line, 3 line break,
    2 end of sentence, 1 clause, 0 none."""
    kinds = np.zeros(len(spans), dtype=np.int8)
    for k in range(1, len(spans)):
        end, start = spans[k - 1][1], spans[k][0]
        if end == start:
            continue
        gap = text[end:start]
        if "\n" in gap:
            kinds[k] = 4 if _BLANK_LINE.search(gap) else 3
        else:
            last = text[spans[k - 1][0] : end]
            kinds[k] = 2 if _ENDS.search(last) else 1 if _PAUSES.search(last) else 0
    return kinds


def cut_points(roll: np.ndarray, kinds: np.ndarray, limit: int, overlap: int, every: int = 64) -> list[int]:
    """Token positions at which pieces end (the last is the number of tokens)."""
    n, cuts, at = len(roll), [], 0
    while True:
        room = limit if not cuts else limit - overlap
        if n - at <= room:
            return [*cuts, n]
        least = max(at + 1, at + room // 2, at + overlap if cuts else 1)
        low, high = least, at + room
        window = roll[low : high + 1]
        marks = np.flatnonzero(window % np.uint64(every) == 0)
        target = low + int(marks[np.argmin(window[marks])] if len(marks) else np.argmin(window))
        best = target
        for kind in (4, 3, 2, 1):
            near = np.flatnonzero(kinds[low : high + 1] == kind)
            if len(near):
                best = low + int(near[np.argmin(np.abs(near - (target - low)))])
                break
        cuts.append(best)
        at = best


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces as ``first token, end token, first character, end character``."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, len(spans), 0, len(text))]
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(text[a:b]) for a, b in spans), dtype=np.uint64, count=len(spans))
    cuts = cut_points(_rolling(hashes), boundary_kinds(text, spans), limit, overlap)
    pieces, at = [], 0
    for end in cuts:
        first = max(0, at - overlap)
        # white space before a piece's first token belongs to the piece before it
        left = 0 if first == 0 else spans[first][0]
        right = len(text) if end == len(spans) else spans[end][0]
        pieces.append((first, end, left, right))
        at = end
    return pieces


PIECES = "piece_no int, first_token bigint, end_token bigint, first_char bigint, end_char bigint, piece string"


def split_oversized(documents: DataFrame, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens, in order from 0.

    Result: ``doc_id, piece_no, first_token, end_token, first_char, end_char, piece``.
    Ends are exclusive; characters are counted in code points. Dropping the first
    ``overlap`` tokens of each later piece and joining gives the text back. Texts of at
    most ``limit`` tokens, null and empty texts give no rows. Repeated rows give their
    pieces again; extra columns are ignored, whatever their names. A text without any
    boundary is cut at landmarks. ``overlap`` must be below half of ``limit``.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and below half of the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                pieces = split_text(text, limit, overlap)
                if len(pieces) > 1:
                    rows += [(doc, k, *p, text[p[2] : p[3]]) for k, p in enumerate(pieces)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "first_token", "end_token", "first_char", "end_char", "piece"])

    long = documents.select("doc_id", "text").where(F.length("text") > limit)
    return long.mapInPandas(cut, f"doc_id {dict(documents.dtypes)['doc_id']}, {PIECES}")

"""Evaluation passages leaking into training text.

The evaluation items form a small inverted index with BM25 weights. Every document is cut
into passages of two strides of ``run`` words, one starting at each stride, so that each
``run`` consecutive words lie in a passage, and every passage is a query against the index.
An item's weights are divided by the least score that any of its runs of ``run`` words
gets, so a passage that holds such a run scores at least 1 and retrieving all items above 1
loses nothing.

Retrieval is block-max WAND, evaluated for many passages at once: a passage whose terms'
maxima cannot reach 1 has no pivot and ends there; items lie in blocks, and a block is skipped
unless the block maxima of the passage's distinct terms reach 1; the items of the blocks that
are left are scored in full. What is retrieved is verified by aligning the passage with the
item word by word: nothing else finds a row.

Documents are scanned once for every ``SHARDS`` shards of items and only the pairs found leave
the scan: no shuffle of text. A shard holds a bounded number of bytes of items, and a task's
worker holds the indexes of the scan's shards only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import WORD

K1, B = 1.2, 0.75
#: Bytes of item text in one index, and indexes that one scan of the documents holds.
SHARD_BYTES, SHARDS = 1 << 20, 8
BLOCK = 16  # items in a block
REACHED = 1 - 1e-4  # the threshold less what rounding to 32 bits can take
ROWS = 4096  # passages evaluated together
WORDS_AT_ONCE = 1 << 20  # words of documents held as numbers
_SENTENCE = re.compile(r"[.!?:](?=\s)")


def question_start(text: str) -> int:
    """Words of the item before its last sentence, where that is a question; else all."""
    ends = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    asks = text.rstrip().endswith("?") and ends
    return len(WORD.findall((text[: ends[-1]] if asks else text).lower()))


class ItemIndex:
    """BM25 weights of items by term and block of items, scaled to a threshold of 1."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        rows = [(item, WORD.findall((text or "").lower()), text) for item, text in items]
        rows = [r for r in rows if r[0] is not None and len(r[1]) >= run]
        self.ids = [r[0] for r in rows]
        self.asks = [question_start(r[2]) for r in rows]
        listed = [r[1] for r in rows]
        n = len(rows)
        df = Counter(w for words in listed for w in set(words))
        self.term = {w: t for t, w in enumerate(df)}
        self.words = [np.array([self.term[w] for w in words], dtype=np.int32) for words in listed]
        mean = sum(map(len, listed)) / n if n else 1.0
        idf = np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df.values()])
        self.none = len(df)  # the term of words that no item has; its weights are 0
        blocks = -(-n // BLOCK)
        self.cell = np.zeros((self.none + 1, blocks), dtype=np.int32)  # row of ``weight``, 0 if the block lacks the term
        weights = [np.zeros(BLOCK, dtype=np.float32)]
        for i, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / mean)
            terms, at, tf = np.unique(words, return_inverse=True, return_counts=True)
            weight = idf[terms] * tf * (K1 + 1) / (tf + norm)
            least = min(weight[np.unique(at[s : s + run])].sum() for s in range(len(words) - run + 1))
            for t, x in zip(terms, weight / least, strict=True):
                if not self.cell[t, i // BLOCK]:
                    self.cell[t, i // BLOCK] = len(weights)
                    weights.append(np.zeros(BLOCK, dtype=np.float32))
                weights[self.cell[t, i // BLOCK]][i % BLOCK] = x
        self.weight = np.stack(weights)
        self.block_max = self.weight.max(1)[self.cell]
        self.top = self.block_max.max(1) if blocks else np.zeros(self.none + 1, dtype=np.float32)

    def numbers(self, text: str) -> list[int]:
        none, term = self.none, self.term
        return [term.get(w, none) for w in WORD.findall(text.lower())]

    def retrieve(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (passage, item) of all that score 1 or more; ``passages`` are rows of terms."""
        terms = np.sort(passages, axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = self.none  # a term counts once
        live = np.flatnonzero(self.top[terms].sum(1) >= REACHED)
        terms = terms[live]
        bound = np.zeros((len(terms), self.cell.shape[1]), dtype=np.float32)
        for column in terms.T:
            bound += self.block_max[column]
        row, block = np.nonzero(bound >= REACHED)
        score = np.zeros((len(row), BLOCK), dtype=np.float32)
        for column in terms.T:
            score += self.weight[self.cell[column[row], block]]
        hit, place = np.nonzero(score >= REACHED)
        return live[row[hit]], block[hit] * BLOCK + place

    def shared(self, passages: np.ndarray, item: int) -> np.ndarray:
        """For each passage, which words of the item lie in ``run`` words that both have in a row."""
        words, run = self.words[item], self.run
        length = np.zeros((len(passages), len(words) + 1), dtype=np.int16)
        ends = np.zeros((len(passages), len(words)), dtype=bool)
        for column in passages.T:
            length[:, 1:] = np.where(column[:, None] == words, length[:, :-1] + 1, 0)
            ends |= length[:, 1:] >= run
        held = np.zeros_like(ends)
        for back in range(run):
            held[:, : len(words) - back] |= ends[:, back:]
        return held

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """``(text, item, words, question words)``: words of the item in runs that the text shares."""
        run = self.run
        out, held, total = [], [], 0
        for k, text in enumerate(texts):
            ids = self.numbers(text)
            if len(ids) >= run:
                held.append((k, ids))
                total += len(ids)
            if held and (total > WORDS_AT_ONCE or k == len(texts) - 1):
                out += self._found(held)
                held, total = [], 0
        return out + (self._found(held) if held else [])

    def _found(self, held: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
        run = self.run
        strides = np.array([-(-len(ids) // run) for _, ids in held])
        halves = np.full((strides.sum() + 1, run), self.none, dtype=np.int32)
        first = np.r_[0, np.cumsum(strides)]
        for at, (_, ids) in zip(first, held, strict=False):
            halves[at : at + -(-len(ids) // run)].reshape(-1)[: len(ids)] = ids
        text = np.repeat([k for k, _ in held], strides)
        following = np.arange(1, len(halves))
        following[first[1:] - 1] = len(halves) - 1
        # passages that no term's maxima lift to 1 have no pivot, whatever the item
        sums = self.top[halves].sum(1)
        live = np.flatnonzero(sums[:-1] + sums[following] >= REACHED)
        rows, items = [], []
        for start in range(0, len(live), ROWS):
            part = live[start : start + ROWS]
            row, item = self.retrieve(np.hstack([halves[part], halves[following[part]]]))
            rows.append(part[row])
            items.append(item)
        rows, items = np.concatenate(rows or [live]), np.concatenate(items or [live])
        order = np.lexsort((rows, items))
        found = []
        for group in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
            if len(group):
                item = int(items[group[0]])
                at = rows[group]
                shared = self.shared(np.hstack([halves[at], halves[following[at]]]), item)
                sure = shared.any(1)
                for k in np.unique(text[at[sure]]):
                    whole = shared[(text[at] == k) & sure].any(0)
                    found.append((int(k), item, int(whole.sum()), int(whole[self.asks[item] :].sum())))
        return found


_BUILT: dict[int, ItemIndex] = {}


def _index(shard, run: int) -> ItemIndex:
    """The index of a broadcast shard, built once per worker and scan."""
    if shard.number not in _BUILT:
        while len(_BUILT) >= SHARDS:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[shard.number] = ItemIndex(shard.rows.value, run)
    return _BUILT[shard.number]


class _Shard:
    def __init__(self, number: int, rows):
        self.number, self.rows = number, rows


_COUNT = iter(range(1 << 62))


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """``doc_id, item_id, words, question_words``: documents with ``run`` consecutive words of an item.

    ``words`` of the item lie in such runs, ``question_words`` of them in the item's closing
    question. ``documents(doc_id, text)``, ``items(item_id, text)``; extra columns are ignored.
    Null or empty texts, items shorter than ``run`` words and rows with a null id give
    nothing; a repeated document or item gives its pair once, with the most words of the
    texts under its id. Items of equal text are all reported.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    held = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * run - 1))
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, words int, question_words int"
    count = max(1, -(-held // SHARD_BYTES))
    found = None
    for first in range(0, count, SHARDS):
        shards = []
        for k in range(first, min(count, first + SHARDS)):
            part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else rows
            shards.append(_Shard(next(_COUNT), spark.sparkContext.broadcast([tuple(r) for r in part.collect()])))

        def scan(batches: Iterator[pd.DataFrame], shards=shards) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = list(batch["doc_id"]), list(batch["text"])
                for index in (_index(s, run) for s in shards):
                    hits = [(ids[k], index.ids[i], n, q) for k, i, n, q in index.leaks(texts)]
                    if hits:
                        yield pd.DataFrame(hits, columns=["doc_id", "item_id", "words", "question_words"])

        pairs = docs.mapInPandas(scan, schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("question_words").alias("question_words"))

"""Near-duplicate records by exact tiled comparison of word-set bit vectors.

Texts of equal word sets form one class. Each class gets a 512-bit vector (a bit per
hashed word) and meets others only in the blocks of its rarest words: two sets of
similarity ``t`` always share a word among the first ``|x| - ceil(t|x|) + 1`` of the
larger and the first ``|y| - ceil(2t/(1+t)|y|) + 1`` of the smaller, in any common word
order. Inside a block, tiles sorted by population count are compared with exclusive-or and
bit counts; tile pairs whose population counts differ beyond the radius are skipped. A
bit that differs stands for a word that differs, so the radius loses nothing; what passes
is verified on the words themselves.

The word order comes from a count sketch of two hash rows, as wide as the number of words asks
for up to a fixed bound (the only thing sent to all tasks); where it overcounts, blocks are
larger and nothing is lost. A word of many classes is cut into sub-blocks by class hash, and each pair of
sub-blocks is its own unit of work, so no block is ever one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import consolidate
from loomgraph.llm.frames import group_starts, whole_groups
from loomgraph.llm.tokens import WORD, hash_words
from loomgraph.session import Scratch

LANES = 8  # 64-bit lanes of a vector
#: Least and most slots of a row of the sketch; two rows of the most take 32 MB.
SLOTS = (1 << 16, 1 << 22)
CHUNK = 1 << 16
SUB_BLOCK = 4096
TILE = 256
#: Row pairs of small blocks, each a tile of its own, that are compared together.
TOGETHER = 1 << 20


def overlap_needed(t: float, total: int) -> int:
    """Least number of shared words of two sets with ``total`` words together."""
    return math.ceil(t / (1 + t) * total - 1e-9)


def word_classes(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``id, class_key, text_key, words``: hashed distinct words of the fields together.

    Null fields count as empty; records without words have a null ``class_key``. Exact
    copies have one ``text_key``, equal word sets one ``class_key``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            keys, texts, sets = [], [], []
            for row in zip(*(batch[f] for f in fields), strict=True):
                words = sorted(set(WORD.findall(" ".join(x for x in row if x).lower())))
                keys.append(xxhash.xxh3_128_hexdigest(" ".join(words)) if words else None)
                texts.append(xxhash.xxh3_128_hexdigest("\0".join(f"{len(x or '')} {x or ''}" for x in row)))
                sets.append(hash_words(words).view(np.int64))
            if keys:
                yield pd.DataFrame({"id": batch["id"], "class_key": keys, "text_key": texts, "words": sets})

    kind = dict(records.dtypes)["id"]
    return records.select("id", *fields).mapInPandas(run, f"id {kind}, class_key string, text_key string, words array<bigint>")


def sketch_slots(words: int) -> int:
    """Slots of a row for this many words, repeated ones counted: a quarter as many, within bounds."""
    return min(SLOTS[1], max(SLOTS[0], 1 << (max(1, words) // 4).bit_length()))


def _slot(words: np.ndarray, row: int, slots: int) -> np.ndarray:
    return ((words >> np.uint64(32 * row)) % np.uint64(slots)).astype(np.int64)


def _sketch(classes: DataFrame, slots: int) -> np.ndarray:
    """Counts of classes per hash slot of the words, in two rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, slots), dtype=np.int64)
        for batch in batches:
            if len(batch):
                words = np.concatenate(list(batch["words"])).view(np.uint64)
                for row in (0, 1):
                    total[row] += np.bincount(_slot(words, row, slots), minlength=slots)
        chunks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(1))
        yield pd.DataFrame({"chunk": some, "counts": [chunks[k].tobytes() for k in some]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in part["counts"])
        return pd.DataFrame({"chunk": part["chunk"][:1], "counts": [np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()]})

    rows = classes.select("words").mapInPandas(run, "chunk bigint, counts binary").groupBy("chunk").applyInPandas(add, "chunk bigint, counts binary")
    out = np.zeros((2 * slots // CHUNK, CHUNK), dtype=np.int32)
    for chunk, counts in rows.collect():
        out[chunk] = np.frombuffer(counts, dtype=np.int32)
    return out.reshape(2, slots)


def bit_vectors(words: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """A row of ``LANES`` numbers per owner, a bit for each of its hashed words."""
    bits = (words >> np.uint64(20)) % np.uint64(LANES * 64)
    out = np.zeros((owners, LANES), dtype=np.uint64)
    np.bitwise_or.at(out, (owner, (bits // np.uint64(64)).astype(np.int64)), np.uint64(1) << (bits % np.uint64(64)))
    return out


def _placements(t: float, sketch):
    """Rows of the blocks that a class takes part in."""
    need = np.vectorize(overlap_needed, otypes=[np.int64])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sketch.value
        slots = counts.shape[1]
        for batch in batches:
            if not len(batch):
                continue
            n = np.array([len(w) for w in batch["words"]])
            words = np.concatenate(list(batch["words"])).astype(np.int64).view(np.uint64)
            owner = np.repeat(np.arange(len(n)), n)
            df = np.minimum(*(counts[r][_slot(words, r, slots)] for r in (0, 1)))
            bits = bit_vectors(words, owner, len(n))
            pop = np.bitwise_count(bits).sum(1).astype(np.int32)
            order = np.lexsort((words, df, owner))
            words, df = words[order], df[order]
            rank = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            probes = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            indexed = n - need(t, 2 * n) + 1
            at = np.flatnonzero((rank < probes[owner]) & (df >= 2))
            parts = -(-df[at].astype(np.int64) // SUB_BLOCK)
            cid = batch["cid"].to_numpy()
            own = cid[owner[at]] % parts
            keep = rank[at] < indexed[owner[at]]
            held = []
            for some, probe in ((keep, False), (np.ones(len(at), dtype=bool), True)):
                every = np.repeat(np.flatnonzero(some), parts[some])
                step = np.arange(len(every)) - np.repeat(np.cumsum(parts[some]) - parts[some], parts[some])
                held.append((at[every], *((own[every], step) if not probe else (step, own[every])), np.full(len(every), probe)))
            spot, row, col, probe = (np.concatenate(x) for x in zip(*held, strict=True))
            of = owner[spot]
            packed = np.array([b.tobytes() for b in bits] + [None], dtype=object)[:-1]
            yield pd.DataFrame({
                "word": words[spot].view(np.int64), "row": row.astype(np.int32), "col": col.astype(np.int32), "probe": probe,
                "pop": pop[of], "size": n[of].astype(np.int32), "cid": cid[of], "bits": packed[of],
            })

    return run


def tile_matches(bits_y, pop_y, size_y, bits_x, pop_x, size_x, limit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (y, x) within the radius and with the smaller set as y; all inputs sorted by ``pop``."""
    for i in range(0, len(pop_y), TILE):
        yb, yp, ys = bits_y[i : i + TILE], pop_y[i : i + TILE], size_y[i : i + TILE]
        for j in range(0, len(pop_x), TILE):
            xb, xp, xs = bits_x[j : j + TILE], pop_x[j : j + TILE], size_x[j : j + TILE]
            radius = limit[min(len(limit) - 1, int(ys.max()) + int(xs.max()))]
            if xp[0] - yp[-1] > radius or yp[0] - xp[-1] > radius:
                continue
            far = np.zeros((len(yp), len(xp)), dtype=np.uint16)
            for k in range(LANES):
                far += np.bitwise_count(yb[:, k, None] ^ xb[None, :, k])
                if k == LANES // 2 and far.min() > radius:
                    break  # what differs so far is beyond the radius everywhere
            near = far <= limit[ys[:, None] + xs[None, :]]
            near &= ys[:, None] <= xs[None, :]
            y, x = np.nonzero(near)
            if len(y):
                yield y + i, x + j


def pair_matches(bits, pop, size, y, x, limit) -> tuple[np.ndarray, np.ndarray]:
    """Of the row pairs (y, x) those within the radius, with the smaller set as y."""
    radius = limit[size[y] + size[x]]
    live = (size[y] <= size[x]) & (np.abs(pop[y] - pop[x]) <= radius)
    y, x, radius = y[live], x[live], radius[live]
    # half of the lanes tell most pairs apart
    far = np.bitwise_count(bits[0][y] ^ bits[0][x]).sum(1)
    live = far <= radius
    y, x, radius, far = y[live], x[live], radius[live], far[live]
    near = far + np.bitwise_count(bits[1][y] ^ bits[1][x]).sum(1) <= radius
    return y[near], x[near]


def _compare(t: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ("word", "row", "col")):
            size = part["size"].to_numpy()
            limit = np.array([s - 2 * overlap_needed(t, s) for s in range(2 * int(size.max()) + 1)], dtype=np.int64)
            bits = np.frombuffer(b"".join(part["bits"]), dtype=np.uint64).reshape(-1, LANES)
            pop, cid, probe = (part[c].to_numpy() for c in ("pop", "cid", "probe"))
            starts = group_starts(part, ("word", "row", "col"))
            ends = np.r_[starts[1:], len(part)]
            cuts = ends - np.add.reduceat(probe.astype(np.int64), starts)  # index rows stand before the probe rows
            held, asked = cuts - starts, ends - cuts
            small = (held * asked > 0) & (held * asked <= TILE * TILE)
            halves = [np.ascontiguousarray(half) for half in np.split(bits, 2, axis=1)]
            found = []
            for s, c, e in zip(starts[~small], cuts[~small], ends[~small], strict=True):
                if s < c < e:
                    for y, x in tile_matches(bits[s:c], pop[s:c], size[s:c], bits[c:e], pop[c:e], size[c:e], limit):
                        found.append((y + s, x + c))
            # small blocks are a tile each; the pairs of many are compared at once
            s, c, wide, pairs = starts[small], cuts[small], asked[small], (held * asked)[small]
            turn = np.cumsum(pairs) // TOGETHER
            for k in np.unique(turn):
                of = turn == k
                n = pairs[of]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(wide[of], n)
                found.append(pair_matches(halves, pop, size, np.repeat(s[of], n) + at // w, np.repeat(c[of], n) + at % w, limit))
            if found:
                y, x = (cid[np.concatenate(side)] for side in zip(*found, strict=True))
                pairs = np.unique(np.stack([np.minimum(y, x), np.maximum(y, x)], 1)[y != x], axis=0)
                if len(pairs):
                    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def similar_classes(records: DataFrame, fields: tuple[str, ...], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Membership ``id, cid, text_key`` and the pairs ``a, b, similarity`` of similar classes.

    Records that repeat an ``id`` keep one row (the smallest of the fields). Records
    without words are in no class. Equal word sets share a class, so copies are not
    paired here. ``0 < threshold <= 1``; extra columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    spark = records.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    once = records.where("id is not null").groupBy("id").agg(F.min(F.struct(*fields)).alias("r")).select("id", "r.*")
    sets, _ = scratch.keep(word_classes(once, fields).where("class_key is not null"))
    classes = sets.select("class_key", "words").dropDuplicates(["class_key"])
    classes, seen = scratch.keep_with(classes.select(F.monotonically_increasing_id().alias("cid"), "class_key", "words"), words=F.sum(F.size("words")))
    members = sets.select("id", "class_key", "text_key").join(classes.select("class_key", "cid"), "class_key").select("id", "cid", "text_key")
    sketch = spark.sparkContext.broadcast(_sketch(classes, sketch_slots(int(seen["words"] or 0))))
    schema = "word bigint, row int, col int, probe boolean, pop int, size int, cid bigint, bits binary"
    placed = classes.select("cid", "words").mapInPandas(_placements(threshold, sketch), schema)
    # a block lies within one partition; adaptive execution sizes these by what is placed
    blocks = placed.repartition("word", "row", "col").sortWithinPartitions("word", "row", "col", "probe", "pop")
    near = blocks.mapInPandas(_compare(threshold), "a bigint, b bigint")
    near, _ = scratch.keep(near.distinct())
    left = classes.select(F.col("cid").alias("a"), F.col("words").alias("wa"))
    right = classes.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    exact = near.join(left, "a").join(right, "b").select("a", "b", shared.alias("n"), (F.size("wa") + F.size("wb") - shared).alias("all"))
    pairs = exact.where(F.col("n") >= F.lit(threshold) * F.col("all") - 1e-9).select("a", "b", (F.col("n") / F.col("all")).alias("similarity"))
    return scratch.keep(members)[0], scratch.keep(pairs)[0]


#: Texts of a class that meet those of another in one unit of work.
SLICE = 256


def near_duplicate_pairs(records: DataFrame, fields: tuple[str, ...], threshold: float) -> DataFrame:
    """Pairs ``id_a < id_b`` of distinct records at or above the threshold.

    Every two different texts are linked, however many texts share their word sets; the
    texts of a class are cut into slices that meet pairwise. Exact copies are tied to the first
    of their text (its smallest id), and of two different texts each copy of either is paired with
    the first of the other: as many pairs as copies, at every size. A text without copies
    or with one meets every record it is similar to, unless that has copies as well. The grouped
    form is :func:`near_duplicate_groups`.
    """
    members, pairs = similar_classes(records, fields, threshold)
    scratch = Scratch(records.sparkSession, "near-duplicate-texts")
    texts = members.groupBy("cid", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    sizes = texts.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"), F.sum("n").alias("n"))
    texts = texts.join(sizes.select("cid", "slices"), "cid").withColumn("slice", F.pmod(F.xxhash64("text_key"), "slices")).drop("slices")
    same = sizes.where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    linked = pairs.select("a", "b").union(same)
    slices = sizes.select("cid", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    linked = linked.join(slices.toDF("a", "sa"), "a").join(slices.toDF("b", "sb"), "b").where("a <> b or sa <= sb")
    left, right = (texts.select(F.col("cid").alias(c), F.col("slice").alias(f"s{c}"), F.col("text_key").alias(f"t{c}"), F.col("n").alias(f"n{c}"), F.col("first").alias(f"first_{c}")) for c in "ab")
    met = linked.join(left, ["a", "sa"]).join(right, ["b", "sb"])
    met = met.where("a <> b or sa < sb or ta < tb or (ta = tb and na > 1)")
    met, _ = scratch.keep(met.select("ta", "tb", "na", "nb", "first_a", "first_b"))
    a = members.select(F.col("text_key").alias("ta"), F.col("id").alias("x"))
    b = members.select(F.col("text_key").alias("tb"), F.col("id").alias("y"))
    firsts = met.select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
    of_a = met.where("na > 1").join(a, "ta").select("x", F.col("first_b").alias("y"))
    of_b = met.where("nb > 1 and ta <> tb").join(b, "tb").select(F.col("first_a").alias("x"), "y")
    both = firsts.union(of_a).union(of_b).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(records: DataFrame, fields: tuple[str, ...], threshold: float) -> DataFrame:
    """One row per record with words: ``id, class_id, group_id, n_links, n_copies``.

    ``class_id`` is the smallest id among records of equal word sets, ``group_id`` the smallest among
    records linked directly or through others, ``n_links`` the number of other classes
    that the record's class is similar to, ``n_copies`` the size of its class.
    """
    members, pairs = similar_classes(records, fields, threshold)
    named = members.groupBy("cid").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = both.groupBy(F.col("a").alias("cid")).agg(F.count(F.lit(1)).alias("n_links"))
    names = named.select("cid", "class_id")
    ends = pairs.join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    groups = consolidate(ends).select(F.col("member").alias("class_id"), F.col("group").alias("group_id"))
    classes = named.join(links, "cid", "left").join(groups, "class_id", "left")
    classes = classes.select("cid", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return members.join(classes, "cid").drop("cid", "text_key")

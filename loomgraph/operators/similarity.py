"""Candidate pairs by cosine similarity and greedy duplicate leaders.

All pairs of the given vectors count, so the work is blocked: vectors are dealt into
blocks, every pair of blocks is one unit that multiplies two small matrices and emits only
pairs above the thresholds. No unit holds more than two blocks, whatever the skew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.store import ranked
from loomgraph.session import Scratch

BLOCK = 2048


def similar_pairs(vectors: DataFrame, within: float, cross: float, block: int = BLOCK) -> DataFrame:
    """``a, b, similarity, cross_source`` of pairs at or above their threshold.

    ``vectors(id, ord, source_url, vector)`` with finite vectors of one length; ``a`` comes
    before ``b`` in ``ord``. Pairs of one source need ``within``, others ``cross``. Zero
    vectors are similar to nothing. Null sources are one source.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pairs")
    rows, n = scratch.keep(vectors.select("id", "ord", F.coalesce("source_url", F.lit("")).alias("source_url"), "vector"))
    blocks = max(1, -(-n // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # a block meets itself and every other once: unit (i, j) with i <= j
    ends = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    units = ends.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", kind="stable")
        x = np.stack(group["vector"].to_list()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(norm == 0, 1, norm)
        b, i, j = group["block"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
        left, right = (np.flatnonzero(b == i), np.flatnonzero(b == j))
        sims = x[left] @ x[right].T
        source = group["source_url"].to_numpy()
        other = source[left][:, None] != source[right][None, :]
        hit = sims >= np.where(other, cross, within)
        if i == j:
            hit &= left[:, None] < right[None, :]
        p, q = np.nonzero(hit)
        first, second = np.minimum(left[p], right[q]), np.maximum(left[p], right[q])
        ids, order = group["id"].to_numpy(), group["ord"].to_numpy()
        return pd.DataFrame({"a": ids[first], "b": ids[second], "a_ord": order[first], "b_ord": order[second], "similarity": sims[p, q], "cross_source": other[p, q]})

    kind = dict(vectors.dtypes)["id"]
    schema = f"a {kind}, b {kind}, a_ord bigint, b_ord bigint, similarity double, cross_source boolean"
    return units.groupBy("i", "j").applyInPandas(compare, schema)


def candidate_pairs(vectors: DataFrame, within: float = 0.6, cross: float = 0.4, per_claim: int = 5) -> DataFrame:
    """The best ``per_claim`` times as many pairs as vectors: pairs across sources first, then
    by similarity, ties by order of assertion. Adds ``rank`` from 1."""
    wanted = vectors.count() * per_claim
    pairs = similar_pairs(vectors, within, cross).withColumn("similarity", F.round("similarity", 6))
    pairs, _ = Scratch(vectors.sparkSession, "candidates").keep(pairs)
    # counts by hundredth tell which pairs can be among the best; only these are ordered
    step = F.floor(F.col("similarity") * 100)
    held = pairs.groupBy("cross_source", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, None
    for row in sorted(held, key=lambda r: (r.cross_source, r.step), reverse=True):
        least, total = (row.cross_source, row.step), total + row.n
        if total >= wanted:
            break
    if least is not None:
        above = (step >= least[1]) & (F.col("cross_source") == least[0])
        pairs = pairs.where(above if least[0] else above | F.col("cross_source"))
    keys = [F.desc("cross_source"), F.desc("similarity"), F.asc("a_ord"), F.asc("b_ord")]
    return ranked(pairs, *keys).where(F.col("rank") <= wanted).select("a", "b", "similarity", "cross_source", "rank")


def grey_zone(vectors: DataFrame, low: float = 0.8, high: float = 0.92) -> DataFrame:
    """``a, b`` of pairs from ``low`` up to, not including, ``high``, of one source or two."""
    return similar_pairs(vectors, low, low).where(F.col("similarity") < high).select("a", "b")


def batches(pairs: DataFrame, size: int = 15) -> DataFrame:
    """Ranked pairs with the number and the place of each in its batch."""
    return pairs.withColumn("batch", F.floor((F.col("rank") - 1) / size)).withColumn("place", (F.col("rank") - 1) % size)


def place_replies(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """The k-th reply of a batch belongs to its k-th pair; surplus replies are dropped, missing ones ignored.

    ``replies(batch, items)`` with an array column.
    """
    items = replies.select("batch", F.posexplode("items").alias("place", "reply"))
    return pairs.join(items, ["batch", "place"])


def duplicate_leaders(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """``id, leader``: greedy merging in order of assertion.

    ``pairs(a, b)`` of duplicates, ``vertices(id, ord)`` with distinct ``ord``. An unmerged
    record absorbs every later unmerged neighbour. Round by round: a record all of whose
    earlier neighbours are merged leads; one with a leading earlier neighbour is merged into
    the first such. Not the same as connected components: A~B, B~C leaves C on its own.
    """
    scratch = Scratch(pairs.sparkSession, "leaders")
    ords = vertices.select("id", "ord")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("early", "late").distinct()
    before = both.join(ords.toDF("early", "eo"), "early").join(ords.toDF("late", "lo"), "late").where("eo < lo")
    links, live = scratch.keep(before.select("early", "eo", "late"))
    state, _ = scratch.keep(ords.select("id", F.lit(None).cast(dict(ords.dtypes)["id"]).alias("leader")))
    while live:
        # an undecided record without undecided or leading earlier neighbours leads
        held = links.select(F.col("late").alias("id")).distinct()
        ready = state.where("leader is null").join(held, "id", "left_anti").select("id").withColumn("leads", F.lit(True))
        led = links.join(ready.select(F.col("id").alias("early")), "early", "left_semi").groupBy(F.col("late").alias("id")).agg(F.min(F.struct("eo", "early")).alias("m"))
        state, _ = scratch.keep(
            state.join(ready, "id", "left").join(led, "id", "left").select(
                "id", F.coalesce("leader", F.when(F.col("leads"), F.col("id")), F.col("m.early")).alias("leader"))
        )
        open_ids = state.where("leader is null").select("id")
        rest = links.join(open_ids.toDF("late"), "late", "left_semi").join(open_ids.toDF("early"), "early", "left_semi")
        links, live = scratch.keep(rest.select("early", "eo", "late"))
    return state.select("id", F.coalesce("leader", "id").alias("leader"))

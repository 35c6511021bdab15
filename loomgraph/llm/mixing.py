"""Mixing sources to target weights by fitting token budgets.

The budget is the largest total at which every source can give its share within its
repeats. A source is used whole as often as its budget allows; the remainder is an exact
subset-sum over the histogram of document lengths: each length gives its proportional
count, longer lengths fill what that leaves, and a bounded-knapsack dynamic programme over
bit sets closes the last stretch, a longer one where a short one does not come out even; what
no stretch closes is reported. Which documents of a length are taken is drawn by a seeded hash.

Only histograms reach the driver (one row per listed source and exact token length, at most
``max_lengths`` rows in all, checked). Choosing documents sorts within 256 slices of each
length by hash, so a length or source with a third of all rows is never one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.tokens import count_tokens
from loomgraph.session import Scratch

SLICES = 256
#: Stretches of the budget that the dynamic programme closes, in tokens: the next where one leaves a rest.
FITS = (1 << 16, 1 << 18, 1 << 20)


def source_name(column: Column) -> Column:
    """Source names with case, surrounding blanks and blank-or-underscore evened out."""
    bare = F.regexp_replace(F.lower(column), r"^[\s ]+|[\s ]+$", "")
    return F.regexp_replace(bare, r"[\s _]+", "_")


def token_lengths(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens``; null texts have 0 tokens, null sources stay null."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [count_tokens(t) if t else 0 for t in batch["text"]]
            if n:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": n})

    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(measure, f"doc_id {dict(documents.dtypes)['doc_id']}, source string, n_tokens bigint")


def knapsack(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """Counts per length, within those available, whose total is the most up to ``budget``.

    A total equal to the budget is the most there can be; so is any if the budget is within the longest stretch.
    """
    best: dict[int, int] = dict.fromkeys(lengths, 0)
    for fit in FITS:
        taken = _fill(lengths, budget, fit)
        if sum(n * c for n, c in taken.items()) >= sum(n * c for n, c in best.items()):
            best = taken
        left = budget - sum(n * c for n, c in best.items())
        if left <= 0 or budget <= fit or best == lengths:
            break
    return best


def _fill(lengths: dict[int, int], budget: int, fit: int) -> dict[int, int]:
    """Counts that leave at most about ``fit`` tokens to the dynamic programme."""
    taken = dict.fromkeys(lengths, 0)
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    if budget <= 0:
        return taken
    left = budget
    if budget > fit:
        for n, c in lengths.items():
            taken[n] = c * (budget - fit // 2) // total
            left -= taken[n] * n
        for n in sorted(lengths, reverse=True):
            if left <= fit:
                break
            more = min(lengths[n] - taken[n], max(0, (left - fit // 2)) // n)
            taken[n] += more
            left -= more * n
    # bounded counts as powers of two; reach[i] holds the sums after i parcels
    parcels = []
    for n in sorted(lengths):
        spare = min(lengths[n] - taken[n], left // n)
        size = 1
        while spare > 0:
            size = min(size, spare)
            parcels.append((n, size))
            spare -= size
            size *= 2
    mask, reach = (1 << (left + 1)) - 1, [1]
    for n, c in parcels:
        reach.append(reach[-1] | (reach[-1] << (n * c)) & mask)
        if reach[-1] >> left & 1:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(reach) - 1, 0, -1):
        n, c = parcels[i - 1]
        if not reach[i - 1] >> at & 1:
            taken[n] += c
            at -= n * c
    return taken


def plan_mix(histogram: pd.DataFrame, targets: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Copies per (source, length), and one report row per target source."""
    totals = histogram.assign(t=histogram["n_tokens"] * histogram["docs"]).groupby("source")["t"].sum()
    wanted = targets[targets["target_share"] > 0]
    able = [int(totals[r.source]) * int(r.max_repeats) / r.target_share for r in wanted.itertuples() if totals.get(r.source, 0)]
    whole = min(able, default=0.0)
    picks, report = [], []
    for r in targets.itertuples():
        held = int(totals.get(r.source, 0))
        budget = int(np.floor(whole * max(0.0, r.target_share) + 1e-6))
        repeats = min(budget // held, int(r.max_repeats)) if held else 0
        rest = budget - repeats * held if repeats < r.max_repeats else 0
        own = histogram[(histogram["source"] == r.source) & (histogram["n_tokens"] > 0)]
        lengths = dict(zip(own["n_tokens"].astype(int), own["docs"].astype(int), strict=True))
        extra = knapsack(lengths, rest)
        picks += [(r.source, n, repeats, extra[n]) for n in lengths]
        used = repeats * held + sum(n * c for n, c in extra.items())
        report.append((r.source, float(r.target_share), int(r.max_repeats), held, budget, used))
    shares = pd.DataFrame(report, columns=["source", "target_share", "max_repeats", "tokens_held", "tokens_wanted", "tokens_used"])
    every = shares["tokens_used"].sum()
    shares["tokens_short"] = shares["tokens_wanted"] - shares["tokens_used"]
    shares["actual_share"] = shares["tokens_used"] / every if every else 0.0
    return pd.DataFrame(picks, columns=["source", "n_tokens", "whole_copies", "extra_docs"]), shares


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 5, max_lengths: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The chosen records and the report.

    Chosen: ``doc_id, source, n_tokens, copies`` with ``copies`` of at least 1. Report: one
    row per target source with target, wanted, used and actual share, and the tokens by which what
    is used falls short of what is wanted. Sources not listed, null sources and texts without
    tokens are not used. A target source without documents gives nothing, which its row
    shows; the others keep their shares to one another. A listed source that may not be used at
    all bounds the whole mix at nothing. Repeated target rows count once; null shares and repeats count as 0. Repeated
    documents rows count as further documents. Extra columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    docs, _ = scratch.keep(token_lengths(documents).where("source is not null and n_tokens > 0"))
    listed = targets.select(
        source_name(F.col("source")).alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
    ).where("source is not null")
    listed = listed.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    used = docs.join(listed.select("source"), "source", "left_semi")
    histogram, n = scratch.keep(used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    if n > max_lengths:
        raise ValueError(f"{n} distinct lengths exceed the bound of {max_lengths}")
    picks, report = plan_mix(histogram.toPandas(), listed.toPandas())
    pick_rows = spark.createDataFrame(picks, "source string, n_tokens bigint, whole_copies int, extra_docs bigint")
    # the extra documents of a length are those of smallest seeded hash: slices by the
    # hash's top bits are taken whole up to the one in which the count is reached
    drawn = docs.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("slice", F.expr("cast(shiftright(h, 56) as int)"))
    counts = drawn.groupBy("source", "n_tokens", "slice").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
    quota = counts.join(pick_rows, ["source", "n_tokens"]).select(
        "source", "n_tokens", "slice", "held", "whole_copies", (F.col("extra_docs") - F.col("ahead")).alias("quota")
    )
    placed = drawn.join(quota, ["source", "n_tokens", "slice"])
    partly = (F.col("quota") > 0) & (F.col("quota") < F.col("held"))
    sure = placed.where(~partly).withColumn("extra", (F.col("quota") >= F.col("held")).cast("int"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "slice").orderBy("h", "doc_id"))
    edge = placed.where(partly).withColumn("extra", (rank <= F.col("quota")).cast("int"))
    chosen = sure.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("whole_copies") + F.col("extra")).alias("copies"))
    shares = spark.createDataFrame(
        report, "source string, target_share double, max_repeats int, tokens_held bigint, tokens_wanted bigint, tokens_used bigint, tokens_short bigint, actual_share double"
    )
    return chosen.where("copies > 0"), shares

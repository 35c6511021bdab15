"""Consolidating pairwise matches into groups by randomised contraction.

Every round draws a fresh hash order; each vertex hooks to the smallest vertex of its
closed neighbourhood under it. Edges are relabelled and deduplicated, so the graph
shrinks by a constant factor in expectation and the number of rounds is logarithmic in
the number of vertices, whatever the diameter. The mappings of the rounds are kept as
written tables and expanded from the last to the first, over tables that grow
geometrically; every second expansion is written, so no plan spans all rounds. Nothing is
collected or broadcast; a hub with a third of all edges is one key of a
combinable ``min`` and the skewed side of joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch, shuffled


def consolidate(pairs: DataFrame, seed: int = 11) -> DataFrame:
    """``member, group`` for every vertex of ``pairs(a, b)``; ``group`` is the smallest member.

    Pairs count in both directions; repeated pairs count once. Rows with a null end and
    pairs of a vertex with itself link nothing and give no row. Extra columns are
    ignored. An empty input gives an empty result.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    one = pairs.where(F.col("a") != F.col("b")).select("a", "b")
    edges, live = scratch.keep(one.union(one.select("b", "a")).distinct())
    low = edges.select(F.col("a").alias("v"), F.col("a").alias("low")).distinct()
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while live:
        order = _order(seed + len(rounds))
        hook = edges.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("u"))).alias("m"))
        own = F.struct(order("v").alias("h"), F.col("v").alias("u"))
        step, _ = scratch.keep(hook.select("v", F.least("m", own)["u"].alias("label")).join(shuffled(low), "v"))
        # the smallest member below each label; only vertices that still had edges take part
        low = step.groupBy(F.col("label").alias("v")).agg(F.min("low").alias("low"))
        rounds.append((step.select("v", "label"), low))
        left = step.select(F.col("v").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        shrunk = edges.join(shuffled(left), "a").join(shuffled(right), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        previous = edges
        edges, live = scratch.keep(shrunk.distinct())
        if len(rounds) > 1:
            scratch.drop(previous)
    found = None
    for k, (step, low) in enumerate(reversed(rounds)):
        here = step.join(shuffled(low.select(F.col("v").alias("label"), "low")), "label")
        if found is not None:
            # a label that had edges in the next round has its group from there
            later = found.select(F.col("v").alias("label"), F.col("low").alias("later"))
            here = here.join(shuffled(later), "label", "left").withColumn("low", F.coalesce("later", "low"))
        found = here.select("v", "low")
        if k % 2 and k + 1 < len(rounds):
            found, _ = scratch.keep(found)
    found = low if found is None else found
    return found.select(F.col("v").alias("member"), F.col("low").alias("group"))


def _order(seed: int):
    return lambda name: F.xxhash64(F.col(name), F.lit(seed))


def restatement_pairs(edges: DataFrame, types: tuple[str, ...] = ("refines", "supersedes"), prefix: str = "clm_") -> DataFrame:
    """``a, b`` for edges of the given types whose two ends are claim ids, ids made plain."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"^[\s ]+|[\s ]+$", "")
    ends: list[Column] = [plain(F.col("source")).alias("a"), plain(F.col("target")).alias("b")]
    return edges.where(plain(F.col("edge_type")).isin(*types)).select(*ends).where(
        F.col("a").startswith(prefix) & F.col("b").startswith(prefix)
    )

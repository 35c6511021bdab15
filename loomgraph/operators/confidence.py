"""Confidence of claims from correlated evidence and quality dimensions.

One join of edges to both ends, one two-level aggregate for the evidence and one
existence test for contradictions; the claims side is never looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scoring

ASSESSMENT_WEIGHT = 0.3
NO_EVIDENCE = 0.5
CONTRADICTED_ABOVE = 0.7


def evidence_lines(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claim_id, source_url, strength``: active support from active claims.

    An edge without strength counts 0.5; support from an assessment counts 0.3 of it.
    """
    ends = claims.where("status = 'active'").select(F.col("claim_id").alias("source"), "source_url", "category")
    support = edges.where("status = 'active' and edge_type = 'supports'").select("source", F.col("target").alias("claim_id"), "strength")
    weight = F.when(F.col("category") == "assessment", ASSESSMENT_WEIGHT).otherwise(1.0)
    return support.join(ends, "source").select("claim_id", "source_url", (F.coalesce("strength", F.lit(0.5)) * weight).alias("strength"))


def correlation(path_a: Column, path_b: Column) -> Column:
    """Shared part of two provenance paths, of the longer one."""
    return F.size(F.array_intersect(path_a, path_b)) / F.greatest(F.size(path_a), F.size(path_b), F.lit(1))


def evidence_clusters(lines: DataFrame) -> DataFrame:
    """``claim_id, source_url, n, strength`` of lines of one provenance.

    Lines of one source are fully correlated, so a cluster's effective number is one and
    its strength the mean.
    """
    return lines.groupBy("claim_id", "source_url").agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("strength"))


def evidence_scores(clusters: DataFrame) -> DataFrame:
    """``claim_id, evidence, clusters``: independent clusters combined."""
    return clusters.groupBy("claim_id").agg(
        (1 - F.product(1 - F.col("strength"))).alias("evidence"), F.count(F.lit(1)).alias("clusters")
    )


def effective_count(n: Column, mean_correlation: Column) -> Column:
    """Number of independent lines that ``n`` correlated ones amount to."""
    return n / (1 + (n - 1) * mean_correlation)


def cluster_strength(mean: Column, n: Column, mean_correlation: Column) -> Column:
    """Strength of a cluster of correlated lines."""
    return F.when(n == 1, mean).otherwise(1 - F.pow(1 - mean, effective_count(n, mean_correlation)))


def contradicted(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claim_id`` of claims that a contradiction ties to one of confidence above 0.7."""
    against = edges.where("status = 'active' and edge_type = 'contradicts'").select("source", "target")
    both = against.union(against.select("target", "source")).toDF("claim_id", "other")
    firm = claims.where(F.coalesce("confidence", F.lit(0.0)) > CONTRADICTED_ABOVE).select(F.col("claim_id").alias("other"))
    return both.join(firm, "other", "left_semi").select("claim_id").distinct()


def score_claims(claims: DataFrame, edges: DataFrame, source_signals: DataFrame | None = None) -> DataFrame:
    """Confidence of every active claim with its parts.

    ``source_signals(source_url, quality)`` lifts the neutral source quality of 0.5.
    Result: ``claim_id, evidence, quality, confidence, level, clusters, weakest, bottleneck``.
    """
    scores = evidence_scores(evidence_clusters(evidence_lines(claims, edges)))
    against = contradicted(claims, edges).withColumn("against", F.lit(True))
    rows = claims.where("status = 'active'").join(scores, "claim_id", "left").join(against, "claim_id", "left")
    if source_signals is not None:
        rows = rows.join(source_signals.select("source_url", "quality"), "source_url", "left")
        source = F.greatest(F.lit(0.3), F.coalesce("quality", F.lit(0.5)))
    else:
        source = F.lit(0.5)
    quote = F.when(F.col("quote_verified"), 1.0).otherwise(0.3)
    consistency = F.when(F.col("against"), 0.3).otherwise(0.9)
    precision = F.greatest(F.lit(0.5), 1 - F.lit(0.15) * F.size("flags"))
    evidence = F.coalesce("evidence", F.lit(NO_EVIDENCE))
    named = (("source", source), ("quote", quote), ("consistency", consistency), ("precision", precision))
    weakest = F.array_min(F.array(*(F.struct(v.cast("double").alias("v"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, v) in enumerate(named))))
    rows = rows.select(
        "claim_id", "ord", F.col("confidence").alias("previous"), evidence.alias("evidence"),
        (source * quote * consistency * precision).alias("quality"), F.coalesce("clusters", F.lit(0)).alias("clusters"), weakest["n"].alias("weakest"),
    )
    raw = F.col("evidence") * F.col("quality")
    # half up on the binary value, the same in every engine
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return rows.select(
        "claim_id", "ord", "previous", six(F.col("evidence")).alias("evidence"), six(F.col("quality")).alias("quality"),
        six(raw).alias("confidence"), scoring.confidence_level(raw).alias("level"), "clusters", "weakest",
        F.when(F.col("evidence") < F.col("quality"), "evidence").otherwise("quality").alias("bottleneck"),
    )


def confidence_updates(scored: DataFrame, least: float = 0.05) -> DataFrame:
    """Scored claims whose confidence, to three decimals, moved by more than ``least``."""
    return scored.where(F.abs(F.bround("confidence", 3) - F.coalesce("previous", F.lit(0.5))) > least)

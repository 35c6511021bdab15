"""Scoring expressions: intervals, agreement, source quality, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound of each level, highest first.
CONFIDENCE_LEVELS = ((0.90, "very_high"), (0.75, "high"), (0.50, "medium"), (0.25, "low"))
LOWEST_LEVEL = "very_low"


def wilson(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Wilson interval as ``struct(lower, upper)`` within [0, 1]; no trials give (0, 1)."""
    n = trials.cast("double")
    p = successes / n
    z2 = z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    reach = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    none = trials <= 0
    lower = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - reach))
    upper = F.when(none, 1.0).otherwise(F.least(F.lit(1.0), middle + reach))
    return F.struct(lower.alias("lower"), upper.alias("upper"))


# Label of a trial score by the interval's lower bound, highest first.
INTERVAL_LABELS = ((0.8, "HIGH"), (0.5, "MEDIUM"), (0.2, "LOW"))


def interval_label(lower: Column, cross_model: Column, trials: Column | None = None) -> Column:
    """Label of a claim's trials; contested where models agree on less than 0.6."""
    out = F.when(cross_model < 0.6, "CONTESTED")
    if trials is not None:
        out = out.when(trials < 3, "UNKNOWN")
    for bound, name in INTERVAL_LABELS:
        out = out.when(lower > bound, name)
    return out.otherwise("INSUFFICIENT_EVIDENCE")


def model_family(model: Column) -> Column:
    """The part of a model's name before the first slash or hyphen."""
    return F.regexp_extract(model, r"^([^/-]*)", 1)


def agreement(agreed: Column, total: Column, families: Column) -> Column:
    """Share of models that agree, times 0.7 if all are of one family; none give 0."""
    ratio = agreed / total * F.when(families <= 1, 0.7).otherwise(1.0)
    return F.when(total > 0, ratio).otherwise(0.0)


def source_quality(peer_reviewed: Column, citations: Column, h_index: Column, retracted: Column | None = None) -> Column:
    """Quality of a source in [0, 1] from its signals; missing signals add nothing."""
    cites, h = F.coalesce(citations, F.lit(0)), F.coalesce(h_index, F.lit(0))
    score = (
        F.lit(0.5)
        + F.when(F.coalesce(peer_reviewed, F.lit(False)), 0.2).otherwise(0.0)
        + F.when(cites > 100, 0.2).when(cites > 10, 0.1).otherwise(0.0)
        + F.when(h > 20, 0.1).otherwise(0.0)
    )
    score = F.least(F.lit(1.0), score)
    if retracted is None:
        return score
    return F.when(F.coalesce(retracted, F.lit(False)), 0.0).otherwise(score)


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a yes-no question; 0 outside the open interval."""
    inside = (p > 0) & (p < 1)
    return F.when(inside, -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)


def confidence_level(value: Column) -> Column:
    """Name of the level of an unrounded confidence."""
    out = None
    for bound, name in CONFIDENCE_LEVELS:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(LOWEST_LEVEL)


def default_confidence(category: Column) -> Column:
    """Confidence of a claim that has none: 0.5 if empirical, else 0.35."""
    return F.when(category == "empirical", 0.5).otherwise(0.35)


def composite(*dimensions: Column) -> Column:
    """Product of dimensions, each held within [0, 1]; a missing one counts as 0.5."""
    out = F.lit(1.0)
    for d in dimensions:
        out = out * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(d, F.lit(0.5))))
    return out


def credibility_flags(peer_reviewed: Column, source_type: Column, known_reliable: Column) -> Column:
    """Array of the credibility concerns that a source raises."""
    flags = F.array(
        F.when(~F.coalesce(known_reliable, F.lit(True)), "known_unreliable"),
        F.when(~F.coalesce(peer_reviewed, F.lit(False)) & (source_type == "paper"), "not_peer_reviewed"),
    )
    return F.filter(flags, lambda x: x.isNotNull())

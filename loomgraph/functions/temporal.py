"""Bi-temporal validity and gated replacement of claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_at(status: Column, valid_from: Column, valid_until: Column, expired_at: Column, as_of: Column) -> Column:
    """Whether a claim holds on a date: not retired, not expired, bounds inclusive; open bounds hold."""
    return (
        (F.coalesce(status, F.lit("active")) == "active")
        & expired_at.isNull()
        & F.coalesce(as_of >= valid_from, F.lit(True))
        & F.coalesce(as_of <= valid_until, F.lit(True))
    )


def may_replace(old_confidence: Column, new_confidence: Column, age_days: Column, period_days: float = 365.0, most: float = 0.3) -> Column:
    """``struct(allowed, bar)``: newer evidence must reach the old confidence less its decay.

    The decay grows with age up to ``most``; without an old claim everything is allowed.
    """
    decay = F.least(F.lit(most), F.greatest(age_days, F.lit(0)) / F.lit(period_days))
    bar = old_confidence * (1 - decay)
    return F.struct(F.coalesce(new_confidence >= bar, old_confidence.isNull()).alias("allowed"), bar.alias("bar"))

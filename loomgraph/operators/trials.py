"""Verification by repeated trials and the four-tier check of a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scoring
from loomgraph.functions import text as T
from loomgraph.operators.store import ranked

#: Ways in which one claim is put to a model, one trial each.
FRAMINGS = ("neutral", "sceptical", "supportive", "source_only", "counter_evidence")


def trial_prompts(claims: DataFrame) -> DataFrame:
    """``claim_id, framing, role, prompt``: every claim under every framing."""
    framing = F.explode(F.array(*(F.lit(f) for f in FRAMINGS)))
    rows = claims.select("claim_id", "text", framing.alias("framing"))
    prompt = F.format_string("[%s] Answer VERIFIED or UNVERIFIED.\nClaim: %s", "framing", "text")
    return rows.select("claim_id", "framing", F.lit("verification").alias("role"), prompt.alias("prompt"))


def trial_results(replies: DataFrame) -> DataFrame:
    """``claim_id, successes, trials, point, lower, upper, agreement, label`` from ``(claim_id, model, response)``."""
    rows = replies.withColumn("ok", T.verification_verdict(F.col("response")))
    counts = rows.groupBy("claim_id").agg(
        F.count_if("ok").alias("successes"), F.count(F.lit(1)).alias("trials"), F.count_distinct(scoring.model_family(F.col("model"))).alias("families")
    )
    w = scoring.wilson(F.col("successes"), F.col("trials"))
    shared = scoring.agreement(F.col("successes"), F.col("trials"), F.col("families"))
    return counts.select(
        "claim_id", "successes", "trials", (F.col("successes") / F.col("trials")).alias("point"), w["lower"].alias("lower"), w["upper"].alias("upper"),
        shared.alias("agreement"), scoring.interval_label(w["lower"], shared, F.col("trials")).alias("label"),
    )


def assessed_status(dimensions: DataFrame, refuted_below: float = 0.2) -> DataFrame:
    """``claim_id, composite, status`` from five dimensions; a low product refutes the claim."""
    names = ("evidence_strength", "logical_consistency", "adversarial_robustness", "source_quality", "cross_model_agreement")
    score = scoring.composite(*(F.col(n) for n in names))
    return dimensions.select("claim_id", score.alias("composite"), F.when(score < refuted_below, "refuted").otherwise("active").alias("status"))


def four_tiers(claims: DataFrame, edges: DataFrame, texts: DataFrame, verified: DataFrame) -> DataFrame:
    """``claim_id, tier, passed, flags``: the first tier that rejects a claim, else all passed.

    Tiers: coverage of its long words by its source (below 0.2 rejects), a contradiction with
    a ``verified(claim_id)`` claim, credibility flags, wording flags. The last two only flag.
    ``texts(source_url, text, peer_reviewed, source_type, known_reliable)``.
    """
    against = edges.where("status = 'active' and edge_type = 'contradicts'").select("source", "target")
    both = against.union(against.select("target", "source")).toDF("claim_id", "other")
    clash = both.join(verified.select(F.col("claim_id").alias("other")), "other", "left_semi").select("claim_id").distinct().withColumn("clash", F.lit(True))
    rows = claims.join(texts.withColumnRenamed("text", "_source"), "source_url", "left").join(clash, "claim_id", "left")
    coverage = T.key_term_coverage(F.col("text"), F.col("_source"))
    flags = F.concat(
        scoring.credibility_flags(F.col("peer_reviewed"), F.col("source_type"), F.col("known_reliable")), T.overclaim_flags(F.col("text")), T.absolute_flags(F.col("text"))
    )
    tier = F.when(coverage < 0.2, 1).when(F.col("clash"), 2).otherwise(4)
    return rows.select("claim_id", tier.alias("tier"), (tier == 4).alias("passed"), flags.alias("flags"))


def overlapping_batches(claims: DataFrame, size: int = 25, overlap: int = 5) -> DataFrame:
    """``batch, place, claim_id``: claims in order of assertion, neighbours sharing ``overlap`` claims."""
    step = size - overlap
    rows = ranked(claims.select("claim_id", "ord"), F.asc("ord"), name="k").select("claim_id", (F.col("k") - 1).alias("k"))
    last = F.floor(F.col("k") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - size + 1) / step))
    spread = rows.select("claim_id", "k", F.explode(F.sequence(first, last)).alias("batch"))
    return spread.select("batch", (F.col("k") - F.col("batch") * step).alias("place"), "claim_id")

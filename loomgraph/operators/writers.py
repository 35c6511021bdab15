"""What the phases write back: results as drafts of log events.

Every function gives ``ord, event_type, payload``, to be numbered and appended by
:mod:`loomgraph.operators.store`. Payloads are JSON of plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _drafts(rows: DataFrame, order: Column, event_type: str, **fields: Column) -> DataFrame:
    payload = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    return rows.select(order.alias("ord"), F.lit(event_type).alias("event_type"), payload.alias("payload"))


def merges(leaders: DataFrame) -> DataFrame:
    """Supersessions of the records that ``leaders(id, ord, leader)`` merges into another."""
    gone = leaders.where("id <> leader")
    return _drafts(gone, F.col("ord"), "claim.superseded", old_claim_id=F.col("id"), reason=F.lit("duplicate_detected"), merged_into=F.col("leader"))


def confidence_patches(updates: DataFrame) -> DataFrame:
    """Rank changes of the scored claims that passed the gate."""
    return _drafts(
        updates, F.col("ord"), "claim.rank_changed", claim_id=F.col("claim_id"), confidence=F.bround("confidence", 3), confidence_level=F.col("level"),
        cluster_count=F.col("clusters"), weakest_dimension=F.col("weakest"),
    )


def entailment_patches(flagged: DataFrame, claims: DataFrame) -> DataFrame:
    """A flag for every claim of ``flagged(claim_id, verdict, confidence)``, and a rank change where it has a confidence."""
    rows = flagged.join(claims.select("claim_id", "ord"), "claim_id")
    notes = _drafts(rows, F.col("ord") * 2, "meta.flag", flag_type=F.lit("entailment"), claim_id=F.col("claim_id"), verdict=F.col("verdict"))
    patched = rows.where("confidence is not null")
    return notes.unionByName(_drafts(patched, F.col("ord") * 2 + 1, "claim.rank_changed", claim_id=F.col("claim_id"), confidence=F.col("confidence")))


def settling_flags(settled: DataFrame, claims: DataFrame) -> DataFrame:
    """Flags of the verdicts given while what they rest on is open."""
    rows = settled.where("detected").join(claims.select(F.col("claim_id").alias("verdict_id"), "ord"), "verdict_id")
    kinds = F.array_compact(F.array(F.when(F.col("n_contested") + F.col("n_cruxes") > 0, "factual"), F.when(F.col("n_framework") > 0, "framework")))
    return _drafts(
        rows, F.col("ord"), "meta.flag", flag_type=F.lit("settling"), verdict_claim_id=F.col("verdict_id"), settling_type=kinds,
        severity=F.bround("severity", 3), dependency_count=F.col("n_dependencies"),
    )


def revised_edges(revised: DataFrame) -> DataFrame:
    """Edges re-asserted under their ids with their new type and the one before it.

    ``revised(edge_id, edge_type, source, target, strength, revised_from)``; a type of
    ``none`` is written as such, which retires the edge for every reader of types.
    """
    order = F.regexp_extract("edge_id", r"(\d+)$", 1).cast("bigint")
    fields = {c: F.col(c) for c in ("edge_id", "edge_type", "source", "target", "strength", "revised_from")}
    return _drafts(revised, order, "edge.asserted", **fields)


def stated_positions(positions: DataFrame, labels: DataFrame, strongest: int = 5) -> DataFrame:
    """Positions with their members in order, their label and their ``strongest`` members by confidence.

    ``positions(position_id, claim_id, ord, confidence)``, ``labels(position_id, label, summary, core_claim)``.
    """
    member = F.struct("ord", "claim_id")
    strong = F.struct((-F.coalesce("confidence", F.lit(0.5))).alias("c"), "ord", "claim_id")
    held = positions.groupBy("position_id").agg(F.sort_array(F.collect_set(member)).alias("m"), F.slice(F.sort_array(F.collect_set(strong)), 1, strongest).alias("s"))
    rows = held.join(labels, "position_id")
    return _drafts(
        rows, F.xxhash64("position_id"), "position.stated", position_id=F.col("position_id"), label=F.col("label"), summary=F.col("summary"),
        core_commitment=F.col("core_claim"), member_claims=F.col("m.claim_id"), strongest_claims=F.col("s.claim_id"),
    )

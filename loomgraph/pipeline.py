"""The phases of a case as functions of tables, and a command line for them.

``python -m loomgraph.pipeline FOLDER OUT --phase full`` reads recorded tables and writes
the results of each phase as Parquet folders below ``OUT``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from loomgraph.config import Settings, load_settings
from loomgraph.operators import confidence, discourse, graph, similarity
from loomgraph.session import build_session
from loomgraph.sources import claims as adapters

PHASES = ("relationships", "confidence", "discourse", "full")


def relationships(spark: SparkSession, folder: str, settings: Settings) -> dict[str, DataFrame]:
    """Duplicates by leader and the batched candidate pairs of what is left."""
    r = settings.relationships
    claims = adapters.claims_view(spark, folder).where("status = 'active'").selectExpr("claim_id as id", "ord", "source_url")
    vectors = adapters.vectors_view(spark, folder).join(claims, "id")
    leaders = similarity.duplicate_leaders(similarity.similar_pairs(vectors, r.merge_threshold, r.merge_threshold), vectors)
    kept = vectors.join(leaders.where("id = leader").select("id"), "id", "left_semi")
    pairs = similarity.candidate_pairs(kept, r.within_threshold, r.cross_threshold, r.pairs_per_claim)
    return {"leaders": leaders, "pairs": similarity.batches(pairs, r.batch_size)}


def scored(spark: SparkSession, folder: str, settings: Settings) -> dict[str, DataFrame]:
    """Confidences and the updates that pass the gate."""
    rows = confidence.score_claims(*adapters.graph_views(spark, folder))
    return {"confidence": rows, "updates": confidence.confidence_updates(rows, settings.change_gate)}


def discussed(spark: SparkSession, folder: str, settings: Settings) -> dict[str, DataFrame]:
    """Positions merged and compared, and what settling shows."""
    claims, edges = adapters.graph_views(spark, folder)
    positions = discourse.merge_positions(adapters.positions_view(spark, folder), edges)
    verdicts = graph.verdict_claims(claims)
    return {
        "positions": positions,
        "disagreements": discourse.disagreements(positions, edges),
        "settling": graph.settling(claims, graph.turned_edges(edges, verdicts), verdicts),
    }


def run(spark: SparkSession, folder: str, out: str, phase: str = "full", settings: Settings | None = None) -> list[str]:
    """Run a phase, or all, and write its tables; returns their names."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase: {phase}")
    settings = settings or load_settings()
    steps = {"relationships": relationships, "confidence": scored, "discourse": discussed}
    names = []
    for name, step in steps.items():
        if phase in (name, "full"):
            for table, df in step(spark, folder, settings).items():
                df.write.mode("overwrite").parquet(f"{out}/{table}")
                names.append(table)
    return names


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--phase", choices=PHASES, default="full")
    args = parser.parse_args(arguments)
    print(*run(build_session(), args.folder, args.out, args.phase), sep="\n")


if __name__ == "__main__":
    main()

"""Counts and roll-ups of the graph, and what its pages list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def graph_counts(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, name, n``: active claims by category, active edges by type, sources."""
    live = claims.where("status = 'active'")
    rows = live.groupBy(F.lit("category").alias("section"), F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    kinds = edges.where("status = 'active'").groupBy(F.lit("edge_type").alias("section"), F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    totals = live.agg(F.lit("total").alias("section"), F.lit("claims").alias("name"), F.count(F.lit(1)).alias("n"))
    sources = live.agg(F.lit("total").alias("section"), F.lit("sources").alias("name"), F.count_distinct("source_title").alias("n"))
    return rows.unionByName(kinds).unionByName(totals).unionByName(sources)


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Calls and tokens by model with a grand total (null model): ``usage(model, input_tokens, output_tokens)``."""
    return usage.rollup("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )


def claim_page_links(claims: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """What a claim's page lists: numbers of supporting and contradicting edges and of positions."""
    live = edges.where("status = 'active'")
    into = live.groupBy(F.col("target").alias("claim_id")).agg(
        F.count_if(F.col("edge_type") == "supports").alias("supporting"), F.count_if(F.col("edge_type") == "contradicts").alias("contradicting")
    )
    held = positions.groupBy("claim_id").agg(F.count_distinct("position_id").alias("positions"))
    return claims.select("claim_id").join(into, "claim_id", "left").join(held, "claim_id", "left").na.fill(0)


def claim_links(claims: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``claim_id, kind, other``: what each claim's page links to, a row per link.

    Supporting and contradicting claims and the positions that hold the claim. Rows, not
    lists: a hub has as many as it has.
    """
    live = edges.where("status = 'active' and edge_type in ('supports', 'contradicts')")
    into = live.select(F.col("target").alias("claim_id"), F.col("edge_type").alias("kind"), F.col("source").alias("other"))
    held = positions.select("claim_id", F.lit("position").alias("kind"), F.col("position_id").alias("other"))
    every = into.where("other is not null").union(held).distinct()
    return every.join(claims.select("claim_id"), "claim_id", "left_semi")


def members_shown(positions: DataFrame, shown: int = 15) -> DataFrame:
    """``position_id, claim_id, place, open``: members in order; those beyond the first ``shown`` are folded away."""
    place = F.row_number().over(Window.partitionBy("position_id").orderBy("ord", "claim_id"))
    return positions.select("position_id", "claim_id", place.alias("place")).withColumn("open", F.col("place") <= shown)


def source_names(claims: DataFrame) -> DataFrame:
    """Distinct titles of the sources of claims that stand, in order."""
    return claims.where("status = 'active' and source_title is not null").select("source_title").distinct().orderBy("source_title")


def average_confidence(scored: DataFrame) -> DataFrame:
    """One row: the number of scored claims and their mean confidence to three decimals, 0 without claims."""
    return scored.agg(F.count(F.lit(1)).alias("claims"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("confidence"))


def level_counts(scored: DataFrame) -> DataFrame:
    """Claims per confidence level."""
    return scored.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def is_settled(cruxes: DataFrame, positions: DataFrame) -> bool:
    """Whether a case has no crux and at most one position."""
    return not cruxes.where("score > 0").head(1) and len(positions.select("position_id").distinct().head(2)) <= 1


def settling_report(settled: DataFrame) -> DataFrame:
    """``settled`` as it is, or one row that says that nothing was detected where no verdict was found."""
    spark = settled.sparkSession
    one = spark.range(1).select(*(F.lit(False).alias(n) if n == "detected" else F.lit(0.0 if t == "double" else 0).cast(t).alias(n) if t != "string" else F.lit(None).cast(t).alias(n) for n, t in settled.dtypes))
    some = settled.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return settled.unionByName(one.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n"))


def important_claims(cruxes: DataFrame, positions: DataFrame, first: int = 5) -> DataFrame:
    """Cruxes and the first members of every position, each once."""
    members = positions.groupBy("position_id").agg(F.slice(F.sort_array(F.collect_set(F.struct("ord", "claim_id"))), 1, first).alias("m"))
    return cruxes.select("claim_id").union(members.select(F.explode("m").alias("x")).select("x.claim_id")).distinct()


def site_index(claims: DataFrame, cruxes: DataFrame, positions: DataFrame, settled: DataFrame) -> str:
    """The index page as HTML: the ten first cruxes, positions by size, settling verdicts.

    The lists are short by what they are (a top-k, positions, verdicts), and are fetched as such.
    """
    import html

    row = lambda cells: "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"
    tables = (
        ("Cruxes", cruxes.join(claims.select("claim_id", "text"), "claim_id").orderBy(F.desc("score"), "claim_id").select("claim_id", "score", "text").limit(10)),
        ("Positions", positions.groupBy("position_id").agg(F.count(F.lit(1)).alias("claims")).orderBy("position_id").limit(50)),
        ("Settling", settled.where("detected").orderBy(F.desc("severity"), "verdict_id").select("verdict_id", "severity").limit(50)),
    )
    parts = [f"<h2>{name}</h2><table>{''.join(row(r) for r in df.collect())}</table>" for name, df in tables]
    return f"<!doctype html><meta charset=utf-8><title>Claim graph</title>{''.join(parts)}"


def pending_sources(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """Sources of the registry that no claim was extracted from."""
    return registry.join(claims.select(F.col("source_url").alias("url")), "url", "left_anti")

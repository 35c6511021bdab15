"""Prompts of the model-backed steps as frames: ``role, prompt`` beside the keys of what is asked.

A prompt shows at most so many items, each cut to so many characters, as a reader's
attention (and budget) is what it asks for; the limits are those of the feature. Answers
come from :mod:`loomgraph.operators.providers`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, MEMBERS, CLAIMS, CRUXES = 100, 20, 50, 5


def _ask(rows: DataFrame, role: str, prompt: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.lit(role).alias("role"), prompt.alias("prompt"))


def _short(column: str | Column) -> Column:
    return F.substring(F.coalesce(column, F.lit("")) if isinstance(column, Column) else F.coalesce(F.col(column), F.lit("")), 1, TEXT)


def _first_lines(group: DataFrame, key: str, most: int) -> DataFrame:
    """``key, listed``: the first ``most`` rows of each key in order of ``ord``, as numbered lines.

    The first rows are taken in slices of each key first, so a key of many rows is not one task.
    """
    row = F.struct("ord", _short("text").alias("text"))
    few = lambda c: F.slice(F.sort_array(c), 1, most)
    sliced = group.groupBy(key, F.pmod(F.xxhash64("ord"), F.lit(64)).alias("_s")).agg(few(F.collect_list(row)).alias("m"))
    whole = sliced.groupBy(key).agg(few(F.flatten(F.collect_list("m"))).alias("m"))
    lines = F.transform("m", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"]))
    return whole.select(key, F.array_join(lines, "\n").alias("listed"))


def extraction(chunks: DataFrame, most: int = 5) -> DataFrame:
    """For every chunk: its claims, at most ``most``."""
    head = f"List at most {most} claims of the text as a JSON array with claim, quote (word for word), category and confidence. An empty array is a good answer.\n\n"
    return _ask(chunks, "extract", F.concat(F.lit(head), F.col("chunk")), "doc_id", "chunk_index")


def entailment(claims: DataFrame) -> DataFrame:
    """For every claim that stands and has a verified quote: whether the quote entails it."""
    text = F.format_string("Does the quote entail the claim? Answer as JSON with entailed and verdict.\nQuote: %s\nClaim: %s", "quote", "text")
    return _ask(verifiable(claims), "verify", text, "claim_id")


def verifiable(claims: DataFrame) -> DataFrame:
    """Claims that stand and whose quote was verified."""
    return claims.where("status = 'active' and quote_verified")


def same_claim(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """For pairs too alike to be two claims for certain and too unlike to be one: which it is."""
    rows = with_texts(pairs, claims, "a", "b")
    return _ask(rows, "same", F.format_string("Do both say the same? Answer as JSON with same (true or false).\nA: %s\nB: %s", "a_text", "b_text"), "a", "b")


def with_texts(pairs: DataFrame, claims: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs with the texts of both claims, as ``<left>_text`` and ``<right>_text``."""
    texts = claims.select("claim_id", "text")
    return pairs.join(texts.toDF(left, f"{left}_text"), left).join(texts.toDF(right, f"{right}_text"), right)


def relations(batches: DataFrame, claims: DataFrame) -> DataFrame:
    """For every batch of pairs: the relation of each, in order."""
    rows = with_texts(batches, claims, "a", "b")
    line = F.concat((F.col("place") + 1).cast("string"), F.lit(". A: "), _short("a_text"), F.lit(" | B: "), _short("b_text"))
    listed = rows.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("listed"))
    return _ask(listed, "relate", F.concat(F.lit("Name the relation of A to B for each pair, as a JSON array with type, strength and evidence.\n"), F.col("listed")), "batch")


def contradictions(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """For every contradiction: whether it is one, with both texts in full."""
    rows = with_texts(edges.where("status = 'active' and edge_type = 'contradicts'").select("edge_id", "source", "target"), claims, "source", "target")
    return _ask(rows, "confirm", F.format_string("Can both be true? Answer as JSON with confirmed and type.\nA: %s\nB: %s", "source_text", "target_text"), "edge_id")


def labels(positions: DataFrame, claims: DataFrame) -> DataFrame:
    """For every position: a label and a summary, from its first members."""
    rows = positions.select("position_id", "claim_id", "ord").join(claims.select("claim_id", "text"), "claim_id")
    listed = _first_lines(rows, "position_id", MEMBERS)
    return _ask(listed, "label", F.concat(F.lit("Name the position that these claims take, as JSON with label and summary.\n"), F.col("listed")), "position_id")


def positions(claims: DataFrame) -> DataFrame:
    """One prompt for the positions of a case where clustering finds fewer than two, from its first claims."""
    listed = _first_lines(claims.where("status = 'active'").select(F.lit(0).alias("case"), "ord", "text"), "case", CLAIMS)
    return _ask(listed, "positions", F.concat(F.lit("Group the claims by position, as a JSON array with label and members (their numbers).\n"), F.col("listed")), "case")


def voices(labelled: DataFrame, cruxes: DataFrame) -> DataFrame:
    """One prompt for the perspectives that nobody takes, from the positions and the first cruxes.

    ``labelled(position_id, label)``, ``cruxes(ord, text)`` by falling score.
    """
    stated = labelled.groupBy(F.lit(0).alias("case")).agg(F.array_join(F.array_sort(F.collect_set(_short("label"))), "\n").alias("stated"))
    asked = _first_lines(cruxes.select(F.lit(0).alias("case"), "ord", "text"), "case", CRUXES)
    rows = stated.join(asked, "case", "left")
    return _ask(rows, "voices", F.concat(F.lit("Which perspectives are missing? A JSON array with perspective and reason.\nPositions:\n"), F.col("stated"), F.lit("\nOpen questions:\n"), F.coalesce("listed", F.lit(""))), "case")

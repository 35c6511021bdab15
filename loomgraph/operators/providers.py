"""Model-backed steps behind a replayable provider.

A step is a frame of prompts; a provider answers it. ``recorded`` joins a table of replies
by the prompt's hash, so every pipeline can be replayed offline and compared; a live
provider runs inside ``mapInPandas``, one client per task, with retries. What follows the
reply (parsing, filters, fallbacks) is declarative and the same for both.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.scoring import default_confidence
from loomgraph.operators.store import first_per_key, ranked


def with_key(prompts: DataFrame) -> DataFrame:
    """Adds ``prompt_sha256``, the key of recorded replies, to ``prompts(role, prompt)``."""
    return prompts.withColumn("prompt_sha256", F.sha2(F.concat_ws("\n", "role", "prompt"), 256))


def recorded(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``response`` from ``replies(prompt_sha256, response)``; null where none was recorded."""
    one = replies.groupBy("prompt_sha256").agg(F.max("response").alias("response"))
    return with_key(prompts).join(one, "prompt_sha256", "left")


def live(prompts: DataFrame, connect: Callable[[], Callable[[str, str], str]], attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """Adds ``response`` by calling a client that ``connect`` opens once per task.

    Connection errors and timeouts are tried again with doubled waits; the last one fails
    the task. Limit calls before this step with :func:`within_budget`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        for batch in batches:
            out = []
            for role, prompt in zip(batch["role"], batch["prompt"], strict=True):
                for left in range(attempts - 1, -1, -1):
                    try:
                        out.append(call(role, prompt))
                        break
                    except (ConnectionError, TimeoutError):
                        if not left:
                            raise
                        time.sleep(min(30.0, wait * 2 ** (attempts - 1 - left)))
            yield batch.assign(response=out)

    rows = with_key(prompts)
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, response string")


def within_budget(prompts: DataFrame, budget_tokens: int, per_char: float = 0.25) -> DataFrame:
    """Prompts in order of ``ord`` until their estimated tokens pass the budget.

    The one that passes it is still sent, as the check precedes the call.
    """
    # totals of ranges first, so that no task holds all prompts
    rows = ranked(prompts.withColumn("_cost", F.length("prompt") * per_char), F.asc("ord"), name="_r").withColumn("_part", F.floor((F.col("_r") - 1) / 4096))
    parts = rows.groupBy("_part").agg(F.sum("_cost").alias("_c"))
    ahead = parts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_ahead"))
    within = F.sum("_cost").over(Window.partitionBy("_part").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    spent = F.col("_ahead") + F.coalesce(F.col("_within"), F.lit(0.0))
    rows = rows.withColumn("_within", within).join(ahead, "_part").where(spent < budget_tokens)
    return rows.drop("_cost", "_r", "_part", "_ahead", "_within")


def with_usage(answered: DataFrame, per_char: float = 0.25) -> DataFrame:
    """Adds ``input_tokens, output_tokens``, estimated from the lengths of prompt and response."""
    tokens = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) * per_char)
    return answered.withColumns({"input_tokens": tokens("prompt"), "output_tokens": tokens("response")})


def embedded(texts: DataFrame, connect: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """``id, vector`` of ``texts(id, text)``: a client opened once per task takes each batch in one request.

    Null texts are sent as empty ones. A batch is an Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "vector": call([t or "" for t in batch["text"]])})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<float>")


def extracted_claims(replies: DataFrame, texts: DataFrame, most: int = 50, least_quote: int = 10) -> DataFrame:
    """Claims of the replies to ``(source_url, chunk_index, response)``.

    Blank texts or quotes are rejected, quotes are checked against ``texts(source_url, text)``,
    wordings flagged, categories coerced, confidences defaulted, at most ``most`` kept per
    source, and ids numbered without collisions.
    """
    item = "struct<claim: string, quote: string, category: string, confidence: double, tags: array<string>>"
    rows = replies.select("source_url", "chunk_index", F.posexplode(T.json_rows(F.col("response"), item)).alias("k", "c"))
    rows = rows.where((F.trim("c.claim") != "") & (F.trim("c.quote") != ""))
    rows = rows.join(texts.select("source_url", F.col("text").alias("_source")), "source_url", "left")
    kind = T.category(F.col("c.category"))
    rows = rows.select(
        "source_url", "chunk_index", "k", F.col("c.claim").alias("text"), F.col("c.quote").alias("quote"), kind.alias("category"),
        T.quote_verified(F.col("c.quote"), F.col("_source"), least_quote).alias("quote_verified"), T.overclaim_flags(F.col("c.claim")).alias("flags"),
        F.coalesce(F.col("c.confidence"), default_confidence(kind)).alias("confidence"),
    )
    rows = ranked(first_per_key(rows, "source_url", most, "chunk_index", "k"), F.asc("source_url"), F.asc("rank"), name="ord")
    return rows.withColumn("claim_id", T.numbered("clm", 6, F.col("ord"))).drop("k")


def entailment_flags(replies: DataFrame, penalty: float = 0.1) -> DataFrame:
    """``claim_id, verdict, confidence`` of replies that do not confirm a claim.

    Unreadable replies count as confirmed; a fabrication patches the confidence.
    """
    parsed = T.json_object(F.col("response"), "entailed boolean, verdict string")
    rows = replies.select("claim_id", parsed.alias("r"))
    bad = rows.where(~F.coalesce("r.entailed", F.lit(True)))
    return bad.select("claim_id", F.coalesce("r.verdict", F.lit("unsupported")).alias("verdict"), F.when(F.col("r.verdict") == "fabrication", penalty).alias("confidence"))


def mid_band(claims: DataFrame, share: float = 0.1) -> DataFrame:
    """The share of claims nearest to a confidence of one half, at least one."""
    n = claims.count()
    distance = F.abs(F.coalesce("confidence", F.lit(0.5)) - 0.5)
    return claims.orderBy(F.round(distance, 9), "ord").limit(max(1, int(n * share)) if n else 0)


def classified_edges(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """Edges of batched pairs (``a, b, batch, place``) and their replies; ``none`` is dropped."""
    item = "struct<type: string, strength: double, evidence: string>"
    items = replies.select("batch", F.posexplode(T.json_rows(F.col("response"), item)).alias("place", "e"))
    rows = pairs.join(items, ["batch", "place"]).withColumn("edge_type", T.edge_type(F.col("e.type")))
    rows = rows.where(F.col("edge_type").isin(*T.EDGE_TYPES))
    rows = ranked(rows, F.asc("batch"), F.asc("place"), name="_order")
    return rows.select(T.numbered("edg", 6, F.col("_order")).alias("edge_id"), "edge_type", F.col("a").alias("source"), F.col("b").alias("target"), F.coalesce("e.strength", F.lit(0.5)).alias("strength"), F.col("e.evidence").alias("evidence"))


def reclassified(edges: DataFrame, replies: DataFrame) -> DataFrame:
    """Contradictions that ``replies(edge_id, response)`` do not confirm, under their new type.

    A new type of ``none`` retires the edge.
    """
    parsed = T.json_object(F.col("response"), "confirmed boolean, type string")
    rows = edges.where("edge_type = 'contradicts'").join(replies.select("edge_id", parsed.alias("r")), "edge_id")
    rows = rows.where(~F.coalesce("r.confirmed", F.lit(True)))
    new = T.edge_type(F.col("r.type"))
    known = new.isin(*T.EDGE_TYPES)
    return rows.select("edge_id", F.when(known, new).otherwise("none").alias("edge_type"), "source", "target", "strength", F.col("edge_type").alias("revised_from"), F.when(F.coalesce(known, F.lit(False)), "active").otherwise("superseded").alias("status"))


def confirmed_duplicates(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the grey zone that ``replies(a, b, response)`` call the same; others are not."""
    parsed = T.json_object(F.col("response"), "same boolean")
    same = replies.select("a", "b", parsed.alias("r")).where(F.coalesce("r.same", F.lit(False))).select("a", "b").distinct()
    return pairs.join(same, ["a", "b"], "left_semi")


def fallback_positions(claims: DataFrame, replies: DataFrame, most: int = 50) -> DataFrame:
    """``position_id, label, claim_id, ord`` from one reply that groups the first ``most`` claims by number.

    Numbers count from 1 in order of assertion; numbers without a claim and groups without
    members are passed over.
    """
    shown = first_per_key(claims.where("status = 'active'").select(F.lit(0).alias("case"), "claim_id", "ord"), "case", most, "ord")
    groups = replies.select(F.posexplode(T.json_rows(F.col("response"), "struct<label: string, members: array<int>>")).alias("k", "g"))
    members = groups.select(T.numbered("pos", 2, F.col("k") + 1).alias("position_id"), F.col("g.label").alias("label"), F.explode("g.members").alias("rank")).distinct()
    return members.join(shown, "rank").select("position_id", "label", "claim_id", "ord")


def labelled_positions(positions: DataFrame, replies: DataFrame) -> DataFrame:
    """``position_id, label, summary, core_claim``; without a readable reply the label is the id.

    ``core_claim`` is the member asserted first.
    """
    parsed = T.json_object(F.col("response"), "label string, summary string")
    core = positions.groupBy("position_id").agg(F.min(F.struct("ord", "claim_id")).alias("m")).select("position_id", F.col("m.claim_id").alias("core_claim"))
    rows = core.join(replies.select("position_id", parsed.alias("r")), "position_id", "left")
    return rows.select("position_id", F.coalesce("r.label", "position_id").alias("label"), F.col("r.summary").alias("summary"), "core_claim")


def missing_voices(replies: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` rows per reply with a non-empty perspective."""
    item = "struct<perspective: string, reason: string>"
    rows = replies.select(F.posexplode(T.json_rows(F.col("response"), item)).alias("k", "v"))
    return rows.where((F.trim("v.perspective") != "")).where(F.col("k") < most).select("v.perspective", "v.reason")


def render(template: str, *columns: Column) -> Column:
    """A prompt from a template with ``%s`` places."""
    return F.format_string(template, *columns)

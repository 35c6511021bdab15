"""The append-only log: append, replay, time travel, snapshots, challenges, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import edge_type, numbered
from loomgraph.operators.changefeed import EFFECTS, apply_changes, event_effects
from loomgraph.session import Scratch
from loomgraph.sources.publish import publish, read_current

# Event types of the store.
EVENT_TYPES = (
    "claim.asserted", "edge.asserted", "position.stated", "challenge.raised",
    "claim.rank_changed", "claim.superseded", "meta.flag",
)

LOG_SCHEMA = "event_id string, event_type string, tx bigint, ts timestamp, actor string, method string, supersedes string, payload string"


def ranked(rows: DataFrame, *keys: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 in the order of ``keys``; no task holds more than a range of them.

    Ranks count within the ranges of a range partitioning, moved by the sizes of the ranges
    before. Rows of equal keys are numbered in any order.
    """
    parts = rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    # written once, so that both uses see the same ranges
    parts, _ = Scratch(rows.sparkSession, "ranks").keep(parts)
    held = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = (F.col("_before") + F.col("_k")).cast("bigint")
    return held.join(before.select("_p", "_before"), "_p").withColumn(name, number).drop("_p", "_k", "_before")


def first_per_key(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """At most ``most`` rows of each key, with their ``rank``; a key of many rows is ranked in slices first."""
    ahead = Window.partitionBy(key, "_slice").orderBy(*order)
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("_k", F.row_number().over(ahead)).where(F.col("_k") <= most)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return sliced.withColumn("rank", rank).where(F.col("rank") <= most).drop("_slice", "_k")


def number_events(drafts: DataFrame, last_tx: int = 0) -> DataFrame:
    """Give drafts their ``tx`` and ``event_id`` after ``last_tx``, in order of ``ord``.

    Unknown event types raise. Numbers are dense without sorting in one task.
    """
    kinds = F.when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null")))))
    checked = drafts.withColumn("event_type", F.coalesce(kinds.cast("string"), F.col("event_type")))
    rows = ranked(checked, F.asc("ord"), name="tx").withColumn("tx", F.col("tx") + F.lit(last_tx).cast("bigint"))
    return rows.withColumn("event_id", numbered("evt", 6, F.col("tx")))


def append_events(drafts: DataFrame, path: str, last_tx: int = 0) -> DataFrame:
    """Append numbered drafts to the log folder; returns what was written."""
    rows = number_events(drafts, last_tx)
    keep = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    for column in keep:
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(dict(x.split() for x in LOG_SCHEMA.split(", "))[column]))
    rows.select(*keep).write.mode("append").parquet(path)
    return rows.select(*keep)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Scan a log of JSON lines; blank and malformed lines give no events."""
    raw = spark.read.schema("event_id string, event_type string, tx bigint, timestamp string, actor string, method string, supersedes string, payload string, _bad string")
    rows = raw.option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("event_id is not null").select("event_id", "event_type", "tx", F.to_timestamp("timestamp").alias("ts"), "actor", "method", "supersedes", "payload")


def as_of(events: DataFrame, tx: int) -> DataFrame:
    """The log up to a transaction; a filter, so the order of delivery does not matter."""
    return events.where(F.col("tx") <= tx)


def claim_state(events: DataFrame) -> DataFrame:
    """Claims of the state: ``claim_id, assert_tx, text, category, source_url, confidence, rank, status, created_at, expired_at``.

    The latest patch after the latest assertion that has a confidence overrides it; text that is
    not a number counts as missing. The rank is that of the latest patch, ``normal`` where
    it names none. ``expired_at`` is when a claim that does not stand was superseded last.
    """
    state = apply_changes(event_effects(events, with_body=True)).where("entity_kind = 'claim' and insert_seq > 0")
    body = F.from_json("insert_body", "statement struct<natural_language: string>, category string, source_url string, confidence string")
    patch = F.from_json("patch_body", "new_rank string")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    rows = state.select("entity_id", "insert_seq", "active", "patch_seq", "score_body", "insert_at", "delete_at", body.alias("b"), patch.alias("p"))
    return rows.select(
        F.col("entity_id").alias("claim_id"), F.expr("(insert_seq - 1) div 2").alias("assert_tx"),
        F.col("b.statement.natural_language").alias("text"), F.col("b.category").alias("category"), F.col("b.source_url").alias("source_url"),
        F.coalesce(number("score_body"), number("b.confidence")).alias("confidence"),
        F.when(F.col("patch_seq").isNotNull(), F.coalesce("p.new_rank", F.lit("normal"))).alias("rank"),
        F.when(F.col("active"), "active").otherwise("superseded").alias("status"),
        F.timestamp_micros("insert_at").alias("created_at"), F.when(~F.col("active"), F.timestamp_micros("delete_at")).alias("expired_at"),
    )


def edge_state(events: DataFrame) -> DataFrame:
    """Edges of the state: ``edge_id, assert_tx, edge_type, source, target, strength, status``."""
    state = apply_changes(event_effects(events, with_body=True)).where("entity_kind = 'edge' and insert_seq > 0")
    body = F.from_json("insert_body", "edge_type string, source string, target string, strength string, revised_from string")
    rows = state.select("entity_id", "insert_seq", "active", body.alias("b"))
    return rows.select(
        F.col("entity_id").alias("edge_id"), F.expr("(insert_seq - 1) div 2").alias("assert_tx"),
        F.coalesce(edge_type(F.col("b.edge_type")), F.lit("supports")).alias("edge_type"), F.lower(F.trim("b.source")).alias("source"),
        F.lower(F.trim("b.target")).alias("target"), F.expr("try_cast(b.strength as double)").alias("strength"), "b.revised_from",
        F.when(F.col("active"), "active").otherwise("superseded").alias("status"),
    )


def keyed_state(events: DataFrame, event_type: str, key: str) -> DataFrame:
    """``id, tx, payload``: the latest statement per key, as for positions and challenges."""
    kind = F.regexp_replace(F.lower("event_type"), r"^\s+|\s+$", "")
    rows = events.where((kind == event_type) & F.col("tx").isNotNull()).select(F.lower(F.trim(F.get_json_object("payload", f"$.{key}"))).alias("id"), "tx", "payload")
    return rows.where("id is not null").groupBy("id").agg(F.max(F.struct("tx", "payload")).alias("m")).select("id", "m.tx", "m.payload")


def flags(events: DataFrame) -> DataFrame:
    """``event_id, tx, flag_type, severity`` of distinct flag events."""
    kind = F.regexp_replace(F.lower("event_type"), r"^\s+|\s+$", "")
    rows = events.where(kind == "meta.flag").groupBy(F.lower(F.trim("event_id")).alias("event_id")).agg(F.max("tx").alias("tx"), F.max("payload").alias("payload"))
    return rows.select("event_id", "tx", F.get_json_object("payload", "$.flag_type").alias("flag_type"), F.expr("try_cast(get_json_object(payload, '$.severity') as double)").alias("severity"))


SNAPSHOT_PARTS = ("claims", "edges", "positions", "challenges", "flags")


def save_snapshot(events: DataFrame, path: str) -> int:
    """Publish claims, edges, positions, challenges and flags as of the log's end; returns its last ``tx``.

    Every part names the mark; a snapshot is whole once the last part has it.
    """
    mark = events.agg(F.max("tx")).first()[0] or 0
    parts = (claim_state(events), edge_state(events), keyed_state(events, "position.stated", "position_id"), keyed_state(events, "challenge.raised", "challenge_id"), flags(events))
    for name, df in zip(SNAPSHOT_PARTS, parts, strict=True):
        publish(df.withColumn("up_to_tx", F.lit(mark).cast("bigint")), f"{path}/{name}")
    return mark


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a snapshot by name."""
    return {name: read_current(spark, f"{path}/{name}") for name in SNAPSHOT_PARTS}


def challenge_events(challenges: DataFrame) -> DataFrame:
    """Drafts of a challenge: the statement, a claim of its own, and a contradiction from it.

    ``challenges(ord, challenge_id, target, challenge_type, body, source_url)``. The
    challenge is a claim node, so the contradiction counts in confidence and cascades.
    """
    claim = F.concat(F.lit("clm_"), F.col("challenge_id"))
    said = F.to_json(F.struct("challenge_id", "target", "challenge_type", "body", "source_url"))
    node = F.to_json(F.struct(claim.alias("claim_id"), F.struct(F.col("body").alias("natural_language")).alias("statement"), "source_url"))
    edge = F.to_json(F.struct(F.concat(F.lit("edg_"), F.col("challenge_id")).alias("edge_id"), F.lit("contradicts").alias("edge_type"), claim.alias("source"), "target", F.lit(0.7).alias("strength")))
    drafts = F.array(
        F.struct(F.lit("challenge.raised").alias("event_type"), said.alias("payload"), F.lit(0).alias("k")),
        F.struct(F.lit("claim.asserted").alias("event_type"), node.alias("payload"), F.lit(1).alias("k")),
        F.struct(F.lit("edge.asserted").alias("event_type"), edge.alias("payload"), F.lit(2).alias("k")),
    )
    return challenges.select("ord", F.explode(drafts).alias("d")).select((F.col("ord") * 3 + F.col("d.k")).alias("ord"), "d.event_type", "d.payload")


def log_checks(events: DataFrame) -> DataFrame:
    """One row of counts that a sound log satisfies: deliveries, events, unknown types, and so on."""
    kind = F.regexp_replace(F.lower("event_type"), r"^\s+|\s+$", "")
    known = kind.isin(*EVENT_TYPES)
    created = [e[0] for e in EFFECTS[:2]]
    return events.select(kind.alias("kind"), "tx", "event_id", "payload", known.alias("known")).agg(
        F.count(F.lit(1)).alias("deliveries"), F.count_distinct(F.lower(F.trim("event_id"))).alias("events"),
        F.count_if(~F.coalesce("known", F.lit(False))).alias("unknown_types"), F.count_if(F.col("payload").isNull()).alias("empty_payloads"),
        F.count_if(F.col("kind").isin(*created)).alias("assertions"), F.max("tx").alias("last_tx"),
    )

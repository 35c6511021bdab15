"""Adapters: the recorded tables as the claim graph's typed views.

What a claim or edge says comes from the extraction and trace tables, whether it stands and how
sure it is from the state that the change feed gives: a superseded claim is there with its
status, a patched one with the confidence of its latest patch that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.changefeed import PATCH, apply_changes, event_effects
from loomgraph.session import Scratch, shuffled
from loomgraph.sources.tables import table


def plain_id(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), r"^\s+|\s+$", "")


def state_view(spark: SparkSession, folder: str) -> DataFrame:
    """``entity_id, entity_kind, active, score, expired_at`` of all claims and edges of the log, folded once."""
    effects = event_effects(table(spark, folder, "event_log"), with_scores=True).where(F.col("effect") != PATCH)
    state = apply_changes(effects).where("insert_seq > 0")
    rows = state.select(
        "entity_id", "entity_kind", "active", F.expr("try_cast(score_body as double)").alias("score"),
        F.when(~F.col("active"), F.timestamp_micros("delete_at")).alias("expired_at"),
    )
    return Scratch(spark, "state").keep(rows)[0]


def _with_state(rows: DataFrame, key: str, kind: str, state: DataFrame) -> DataFrame:
    """Rows with ``status``, and with the state's ``score`` and ``expired_at``; what the log lacks is active."""
    held = state.where(F.col("entity_kind") == kind).drop("entity_kind").withColumnRenamed("entity_id", key)
    status = F.when(F.coalesce("active", F.lit(True)), "active").otherwise("superseded")
    return rows.join(shuffled(held), key, "left").withColumn("status", status).drop("active")


def extractions_view(spark: SparkSession, folder: str) -> DataFrame:
    """One row per claim as first extracted, whatever became of it.

    ``ord`` is the claim's number, the order in which ids were given.
    """
    raw = table(spark, folder, "extraction_results").withColumn("claim_id", plain_id(F.col("claim_id")))
    first = F.row_number().over(Window.partitionBy("claim_id").orderBy("extracted_at", "chunk_index"))
    return (
        raw.where("claim_id is not null").withColumn("_n", first).where("_n = 1").select(
            "claim_id",
            F.regexp_extract("claim_id", r"(\d+)$", 1).cast("bigint").alias("ord"),
            F.col("natural_language").alias("text"),
            F.col("relevant_quote").alias("quote"),
            F.coalesce("quote_verified", F.lit(False)).alias("quote_verified"),
            T.category(F.col("category")).alias("category"),
            F.coalesce("overclaiming_flags", F.array().cast("array<string>")).alias("flags"),
            "tags", "source_url", "source_title", "chunk_index", "extraction_model",
            F.coalesce("compliance_pressure", F.lit(False)).alias("under_pressure"),
            F.col("confidence").alias("extracted_confidence"), "valid_from", "valid_until", "extracted_at",
        )
    )


def claims_view(spark: SparkSession, folder: str, state: DataFrame | None = None) -> DataFrame:
    """The extracted claims with the status, expiry and confidence that the log's state gives them."""
    rows = _with_state(extractions_view(spark, folder), "claim_id", "claim", state_view(spark, folder) if state is None else state)
    return rows.withColumn("confidence", F.coalesce("score", "extracted_confidence")).drop("score")


def edges_view(spark: SparkSession, folder: str, state: DataFrame | None = None) -> DataFrame:
    """One row per edge: the latest assertion of each id, types and ids made plain, with its status."""
    raw = table(spark, folder, "trace_edges").select(
        plain_id(F.col("edge_id")).alias("edge_id"), T.edge_type(F.col("edge_type")).alias("edge_type"),
        plain_id(F.col("source")).alias("source"), plain_id(F.col("target")).alias("target"),
        "strength", "evidence", F.col("cosine_similarity").alias("similarity"), "cross_source", "qualifiers", "revised_from", "tx",
    )
    last = F.row_number().over(
        Window.partitionBy("edge_id").orderBy(F.desc_nulls_last("tx"), F.asc_nulls_last("edge_type"), F.asc_nulls_last("source"), F.asc_nulls_last("target"))
    )
    rows = raw.where("edge_id is not null").withColumn("_n", last).where("_n = 1").drop("_n")
    return _with_state(rows, "edge_id", "edge", state_view(spark, folder) if state is None else state).drop("score", "expired_at")


def graph_views(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Claims and edges under one fold of the log."""
    state = state_view(spark, folder)
    return claims_view(spark, folder, state), edges_view(spark, folder, state)


def vectors_view(spark: SparkSession, folder: str, dim: int = 64) -> DataFrame:
    """``id, vector`` of claims with a usable vector, one row each, not scaled."""
    raw = table(spark, folder, "claim_vectors").select(plain_id(F.col("claim_id")).alias("id"), "vector")
    good = (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return raw.where(good & some).groupBy("id").agg(F.min("vector").alias("vector"))


def positions_view(spark: SparkSession, folder: str) -> DataFrame:
    """``position_id, claim_id, ord``: members of every position as it was last stated, in order."""
    log = table(spark, folder, "event_log").where((plain_id(F.col("event_type")) == "position.stated") & F.col("tx").isNotNull())
    body = F.from_json("payload", "position_id string, member_claims array<string>")
    rows = log.select("tx", body.alias("b")).select(plain_id(F.col("b.position_id")).alias("position_id"), "tx", F.col("b.member_claims").alias("members"))
    last = rows.where("position_id <> ''").groupBy("position_id").agg(F.max(F.struct("tx", "members")).alias("m"))
    named = last.select("position_id", F.posexplode("m.members").alias("ord", "claim_id"))
    return named.select("position_id", plain_id(F.col("claim_id")).alias("claim_id"), "ord").where("claim_id <> ''")


def registry_view(spark: SparkSession, folder: str) -> DataFrame:
    """The source registry with its several date forms read as dates."""
    raw = table(spark, folder, "source_registry")
    day = F.trim("date_published")
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM", "yyyy")
    return raw.withColumn("published", F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in forms)).cast("date"))


_PLAIN = r"nullif(regexp_replace(lower({}), '^\s+|\s+$', '', 'g'), '')"


def _field(name: str) -> str:
    return _PLAIN.format(f"json_extract_string(body, '$.{name}')")


#: The log's state: id, kind, latest assertion, whether active, latest patched confidence after it.
STATE_SQL = f"""
st_ev as (
  select {_PLAIN.format('event_type')} as kind, tx, {_PLAIN.format('supersedes')} as ref,
         case when json_valid(payload) then payload end as body, epoch_us(ts) as moment from event_log where tx is not null
), st_own as (
  select kind, tx, ref, moment, body, {_field('claim_id')} as cid, {_field('edge_id')} as eid, {_field('old_claim_id')} as oid,
         json_extract_string(body, '$.confidence') as conf from st_ev
), st_birth as (
  select cid as id, 'claim' as what, max(tx) as tx from st_own where kind = 'claim.asserted' and cid is not null group by 1
  union all select eid, 'edge', max(tx) from st_own where kind = 'edge.asserted' and eid is not null group by 1
), st_death as (
  select b.id, max({{'seq': d.seq, 'moment': d.moment}}) as d from st_birth b join (
    select ref as id, null as what, 2 * tx as seq, moment from st_own where ref is not null
    union all select oid, 'claim', 2 * tx + 1, moment from st_own where kind = 'claim.superseded' and oid is not null) d
  on d.id = b.id and coalesce(d.what, b.what) = b.what group by 1
), st_score as (
  select b.id, max({{'tx': o.tx, 'conf': o.conf}}) as s from st_birth b join st_own o on o.cid = b.id and o.tx > b.tx
  where b.what = 'claim' and o.kind = 'claim.rank_changed' and try_cast(o.conf as double) is not null group by 1
), st_state as (
  select b.id, b.what, b.tx, d.d.seq is null or d.d.seq < 2 * b.tx + 1 as active, d.d.moment as dead_at, d.d.seq as dead_seq, try_cast(s.s.conf as double) as score
  from st_birth b left join st_death d on d.id = b.id left join st_score s on s.id = b.id
)"""

#: ``claims_v`` has every claim, ``active_v`` those that stand.
CLAIMS_SQL = (
    STATE_SQL
    + r"""
, claims_x as (
  select claim_id, regexp_extract(claim_id, '(\d+)$', 1)::bigint as ord, natural_language as text, relevant_quote as quote,
         coalesce(quote_verified, false) as quote_verified,
         case when lower(trim(category)) in ('empirical', 'assessment', 'methodological') then lower(trim(category)) else 'empirical' end as category,
         coalesce(overclaiming_flags, []) as flags, tags, source_url, source_title, extraction_model, confidence as extracted_confidence,
         coalesce(compliance_pressure, false) as under_pressure, valid_from, valid_until, extracted_at
  from (select * replace (regexp_replace(lower(claim_id), '^\s+|\s+$', '', 'g') as claim_id) from extraction_results)
  where claim_id is not null
  qualify row_number() over (partition by claim_id order by extracted_at, chunk_index) = 1
), claims_v as (
  select x.*, coalesce(s.score, x.extracted_confidence) as confidence, case when coalesce(s.active, true) then 'active' else 'superseded' end as status
  from claims_x x left join st_state s on s.id = x.claim_id and s.what = 'claim'
), active_v as (select * from claims_v where status = 'active')"""
)

#: ``edges_all`` has every edge, ``edges_v`` those that stand.
_EDGES_SQL = r"""
edges_all as (
  select x.*, case when coalesce(s.active, true) then 'active' else 'superseded' end as status from (
    select regexp_replace(lower(edge_id), '^\s+|\s+$', '', 'g') as edge_id,
           regexp_replace(regexp_replace(lower(edge_type), '^\s+|\s+$', '', 'g'), '[\s_]+', '_', 'g') as edge_type,
           regexp_replace(lower(source), '^\s+|\s+$', '', 'g') as source, regexp_replace(lower(target), '^\s+|\s+$', '', 'g') as target,
           strength, evidence, cosine_similarity as similarity, cross_source, qualifiers, revised_from, tx
    from trace_edges
    where edge_id is not null
    qualify row_number() over (partition by regexp_replace(lower(edge_id), '^\s+|\s+$', '', 'g') order by tx desc nulls last,
      regexp_replace(regexp_replace(lower(edge_type), '^\s+|\s+$', '', 'g'), '[\s_]+', '_', 'g') nulls last,
      regexp_replace(lower(source), '^\s+|\s+$', '', 'g') nulls last, regexp_replace(lower(target), '^\s+|\s+$', '', 'g') nulls last) = 1) x
  left join st_state s on s.id = x.edge_id and s.what = 'edge'
), edges_v as (select * from edges_all where status = 'active')"""
EDGES_SQL = f"{STATE_SQL}, {_EDGES_SQL}"
GRAPH_SQL = f"{CLAIMS_SQL}, {_EDGES_SQL}"

#: Members of every position as it was last stated.
POSITIONS_SQL = f"""
member as (
  select p.position_id, {_PLAIN.format('m')} as claim_id from (
    select position_id, unnest(last.members) as m from (
      select {_PLAIN.format("json_extract_string(payload, '$.position_id')")} as position_id, max({{'tx': tx, 'members': json_extract_string(payload, '$.member_claims[*]')}}) as last
      from event_log where {_PLAIN.format('event_type')} = 'position.stated' and tx is not null and json_valid(payload) group by 1)
    where position_id is not null) p where {_PLAIN.format('m')} is not null
)"""

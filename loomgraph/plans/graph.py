"""Queries over claims and edges with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scoring, temporal
from loomgraph.functions import text as T
from loomgraph.operators import confidence as C
from loomgraph.operators import discourse as D
from loomgraph.operators import documents as DOC
from loomgraph.operators import graph as G
from loomgraph.operators import prompts
from loomgraph.operators import reports as R
from loomgraph.operators import similarity as S
from loomgraph.operators import store, writers
from loomgraph.operators.changefeed import apply_changes, event_effects
from loomgraph.sources.claims import CLAIMS_SQL, EDGES_SQL, GRAPH_SQL, POSITIONS_SQL, STATE_SQL, claims_view, edges_view, extractions_view, graph_views, positions_view, registry_view, vectors_view
from loomgraph.sources.tables import table
from loomgraph.streaming.fold import arrivals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_BOTH = f"with recursive {GRAPH_SQL}"
_CLAIMS = f"with recursive {CLAIMS_SQL}"
_EDGES = f"with recursive {EDGES_SQL}"

_LINES = """
, lines as (
  select e.target as claim_id, c.source_url, coalesce(e.strength, 0.5) * case when c.category = 'assessment' then 0.3 else 1.0 end as strength
  from edges_v e join active_v c on c.claim_id = e.source where e.edge_type = 'supports' and e.target is not null
), clusters as (
  select claim_id, source_url, count(*) as n, avg(strength) as strength from lines group by 1, 2
), scores as (select claim_id, 1 - product(1 - strength) as evidence, count(*) as clusters from clusters group by 1)
, against as (
  select distinct claim_id from (
    select source as claim_id, target as other from edges_v where edge_type = 'contradicts'
    union all select target, source from edges_v where edge_type = 'contradicts') b
  where other in (select claim_id from claims_v where coalesce(confidence, 0) > 0.7) and claim_id is not null
)"""
_SCORED = (
    _LINES
    + """
, dims as (
  select c.claim_id, c.ord, c.confidence as previous, coalesce(s.evidence, 0.5) as evidence, coalesce(s.clusters, 0) as clusters,
         0.5::double as d0, case when c.quote_verified then 1.0 else 0.3 end::double as d1,
         case when a.claim_id is not null then 0.3 else 0.9 end::double as d2, greatest(0.5, 1 - 0.15 * len(c.flags))::double as d3
  from active_v c left join scores s on s.claim_id = c.claim_id left join against a on a.claim_id = c.claim_id
), scored as (
  select claim_id, ord, previous, floor(evidence * 1e6 + 0.5) / 1e6 as evidence, floor((d0 * d1 * d2 * d3) * 1e6 + 0.5) / 1e6 as quality,
         floor((evidence * (d0 * d1 * d2 * d3)) * 1e6 + 0.5) / 1e6 as confidence,
         case when evidence * (d0*d1*d2*d3) >= 0.9 then 'very_high' when evidence * (d0*d1*d2*d3) >= 0.75 then 'high'
              when evidence * (d0*d1*d2*d3) >= 0.5 then 'medium' when evidence * (d0*d1*d2*d3) >= 0.25 then 'low' else 'very_low' end as level,
         clusters, case when d0 <= d1 and d0 <= d2 and d0 <= d3 then 'source' when d1 <= d2 and d1 <= d3 then 'quote'
                        when d2 <= d3 then 'consistency' else 'precision' end as weakest,
         case when evidence < d0 * d1 * d2 * d3 then 'evidence' else 'quality' end as bottleneck
  from dims
)"""
)


@_query("claim_confidence", f"{_BOTH} {_SCORED} select * from scored")
def claim_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of every claim with its parts."""
    return C.score_claims(*graph_views(spark, folder))


@_query("confidence_updates", f"{_BOTH} {_SCORED} select * from scored where abs(round_even(confidence, 3) - coalesce(previous, 0.5)) > 0.05")
def confidence_updates(spark: SparkSession, folder: str) -> DataFrame:
    return C.confidence_updates(claim_confidence(spark, folder))


@_query("evidence_clusters", f"{_BOTH} {_LINES} select claim_id, source_url, n, round(strength, 6) as strength from clusters")
def evidence_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.evidence_clusters(C.evidence_lines(*graph_views(spark, folder)))
    return rows.where("claim_id is not null").withColumn("strength", F.round("strength", 6))


@_query("contradicted_claims", f"{_BOTH} {_LINES} select claim_id from against")
def contradicted_claims(spark: SparkSession, folder: str) -> DataFrame:
    return C.contradicted(*graph_views(spark, folder)).where("claim_id is not null")


def _state_counts(events: DataFrame) -> DataFrame:
    """Claims and edges by status; the fold carries no bodies."""
    rows = apply_changes(event_effects(events)).where("insert_seq > 0")
    status = F.when(F.col("active"), "active").otherwise("superseded")
    return rows.groupBy("entity_kind", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_STATE_COUNTS = "select what as entity_kind, case when active then 'active' else 'superseded' end as status, count(*) as n from st_state group by 1, 2"


@_query("state_counts", f"with {STATE_SQL} {_STATE_COUNTS}")
def state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _state_counts(table(spark, folder, "event_log"))


@_query("state_as_of", f"with {STATE_SQL.replace('where tx is not null', 'where tx <= 5000', 1)} {_STATE_COUNTS}")
def state_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The state after transaction 5,000."""
    return _state_counts(store.as_of(table(spark, folder, "event_log"), 5000))


_STRIP = r"regexp_replace(lower({}), '^\s+|\s+$', '', 'g')"


@_query(
    "state_edges",
    f"""with {STATE_SQL}
select s.id as edge_id, s.tx as assert_tx,
  coalesce(regexp_replace({_STRIP.format("json_extract_string(o.body, '$.edge_type')")}, '[\\s_]+', '_', 'g'), 'supports') as edge_type,
  {_STRIP.format("json_extract_string(o.body, '$.source')")} as source, {_STRIP.format("json_extract_string(o.body, '$.target')")} as target,
  try_cast(json_extract_string(o.body, '$.strength') as double) as strength, json_extract_string(o.body, '$.revised_from') as revised_from,
  case when s.active then 'active' else 'superseded' end as status
from st_state s join (select eid, tx, max(body) as body from st_own where kind = 'edge.asserted' group by 1, 2) o on o.eid = s.id and o.tx = s.tx
where s.what = 'edge'
""",
)
def state_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the state as their latest assertion gives them."""
    return store.edge_state(table(spark, folder, "event_log"))


@_query(
    "state_claims",
    f"""with {STATE_SQL}
select s.id as claim_id, s.tx as assert_tx, json_extract_string(o.body, '$.statement.natural_language') as text, json_extract_string(o.body, '$.category') as category,
  json_extract_string(o.body, '$.source_url') as source_url, coalesce(s.score, try_cast(json_extract_string(o.body, '$.confidence') as double)) as confidence,
  case when p.tx > s.tx then coalesce(json_extract_string(p.body, '$.new_rank'), 'normal') end as rank,
  case when s.active then 'active' else 'superseded' end as status, o.moment as created_us, case when not s.active then s.dead_at end as expired_us
from st_state s join (select cid, tx, max(body) as body, arg_max(moment, body) as moment from st_own where kind = 'claim.asserted' group by 1, 2) o on o.cid = s.id and o.tx = s.tx
left join (select cid, max({{'tx': tx, 'body': body}}).tx as tx, max({{'tx': tx, 'body': body}}).body as body from st_own where kind = 'claim.rank_changed' group by 1) p on p.cid = s.id
where s.what = 'claim'
""",
)
def state_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of the state with text, confidence after patches, rank, status, creation and expiry."""
    rows = store.claim_state(table(spark, folder, "event_log"))
    return rows.withColumns({"created_us": F.unix_micros("created_at"), "expired_us": F.unix_micros("expired_at")}).drop("created_at", "expired_at")


@_query(
    "flag_events",
    r"""
select lower(trim(event_id)) as event_id, max(tx) as tx, json_extract_string(max(payload), '$.flag_type') as flag_type,
       try_cast(json_extract_string(max(payload), '$.severity') as double) as severity
from event_log where regexp_replace(lower(event_type), '^\s+|\s+$', '', 'g') = 'meta.flag' group by 1
""",
)
def flag_events(spark: SparkSession, folder: str) -> DataFrame:
    return store.flags(table(spark, folder, "event_log"))


@_query(
    "stated_positions",
    r"""
select id, max(tx) as tx from (
  select lower(trim(json_extract_string(payload, '$.position_id'))) as id, tx from event_log
  where regexp_replace(lower(event_type), '^\s+|\s+$', '', 'g') = 'position.stated' and tx is not null) where id is not null group by 1
""",
)
def stated_positions(spark: SparkSession, folder: str) -> DataFrame:
    return store.keyed_state(table(spark, folder, "event_log"), "position.stated", "position_id").select("id", "tx")


@_query(
    "log_checks",
    r"""
select count(*) as deliveries, count(distinct lower(trim(event_id))) as events,
  count_if(not coalesce(kind in ('claim.asserted', 'edge.asserted', 'position.stated', 'challenge.raised', 'claim.rank_changed', 'claim.superseded', 'meta.flag'), false)) as unknown_types,
  count_if(payload is null) as empty_payloads, count_if(kind in ('claim.asserted', 'edge.asserted')) as assertions, max(tx) as last_tx
from (select *, regexp_replace(lower(event_type), '^\s+|\s+$', '', 'g') as kind from event_log)
""",
)
def log_checks(spark: SparkSession, folder: str) -> DataFrame:
    return store.log_checks(table(spark, folder, "event_log"))


@_query(
    "arrivals",
    r"""
select time_bucket(interval '1 day', ingested_at) as day, regexp_replace(lower(event_type), '^\s+|\s+$', '', 'g') as kind, count(*) as deliveries
from event_log where ingested_at is not null group by 1, 2
""",
)
def arrivals_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return arrivals(table(spark, folder, "event_log"))


@_query("valid_claims_as_of", f"{_CLAIMS} select claim_id from active_v where coalesce(date '2022-06-30' >= valid_from, true) and coalesce(date '2022-06-30' <= valid_until, true)")
def valid_claims_as_of(spark: SparkSession, folder: str) -> DataFrame:
    holds = temporal.valid_at(F.col("status"), F.col("valid_from"), F.col("valid_until"), F.col("expired_at"), F.lit("2022-06-30").cast("date"))
    return claims_view(spark, folder).where(holds).select("claim_id")


@_query(
    "supersession_gate",
    f"""{_BOTH}
select e.edge_id, coalesce(n.confidence, 0.5) >= coalesce(o.confidence, 0.5) * (1 - least(0.3, greatest(date_diff('day', o.extracted_at::date, n.extracted_at::date), 0) / 365.0)) as allowed
from edges_all e join claims_v n on n.claim_id = e.source join claims_v o on o.claim_id = e.target where e.edge_type in ('supersedes', 'refines')
""",
)
def supersession_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the newer claim of each refinement may replace the older one."""
    claims, edges = graph_views(spark, folder)
    claims = claims.select("claim_id", F.coalesce("confidence", F.lit(0.5)).alias("c"), "extracted_at")
    edges = edges.where(F.col("edge_type").isin("supersedes", "refines")).select("edge_id", "source", "target")
    rows = edges.join(claims.toDF("source", "new_c", "new_at"), "source").join(claims.toDF("target", "old_c", "old_at"), "target")
    gate = temporal.may_replace(F.col("old_c"), F.col("new_c"), F.datediff("new_at", "old_at"))
    return rows.select("edge_id", gate["allowed"].alias("allowed"))


def _any(patterns, column: str) -> str:
    return " + ".join(f"regexp_matches(lower(coalesce({column}, '')), '{p.replace(chr(39), chr(39) * 2)}')::int" for p in patterns)


@_query("overclaim_flags", f"select doc_id, {_any(T.OVERCLAIMING, 'text')} as n_flags from documents")
def overclaim_flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(T.overclaim_flags(F.col("text"))).alias("n_flags"))


@_query(
    "pressure_level",
    "select doc_id, greatest(1, "
    + ", ".join(f"case when regexp_matches(lower(coalesce(text, '')), '{p.replace(chr(39), chr(39) * 2)}') then {n} else 1 end" for n, p in T.PRESSURE)
    + ") as level from documents",
)
def pressure_level(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.pressure(F.col("text"))["level"].alias("level"))


@_query("verdict_documents", "select doc_id from documents where " + " or ".join(f"contains(lower(text), '{m}')" for m in T.VERDICT_MARKERS))
def verdict_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(T.is_verdict(F.col("text"))).select("doc_id")


@_query(
    "quote_exact",
    rf"""{_CLAIMS}, pages as (select url, max(text) as text from fetch_results group by 1)
select c.claim_id, length(c.quote) >= 10 and contains(trim(regexp_replace(lower(coalesce(p.text, '')), '\s+', ' ', 'g')), trim(regexp_replace(lower(c.quote), '\s+', ' ', 'g'))) as contained
from claims_v c left join pages p on p.url = c.source_url where c.quote is not null
""",
)
def quote_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each quote stands in the text fetched from its source."""
    pages = table(spark, folder, "fetch_results").groupBy(F.col("url").alias("source_url")).agg(F.max("text").alias("page"))
    rows = extractions_view(spark, folder).where("quote is not null").join(pages, "source_url", "left")
    return rows.select("claim_id", T.quote_contained(F.col("quote"), F.col("page")).alias("contained"))


@_query("quote_fuzzy")
def quote_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each quote stands, or its words stand in order, in a text of its source.

    Texts of a source are the pages fetched from its address and the pages and documents
    of its title; a quote without any is not verified.
    """
    rows = extractions_view(spark, folder).where("quote is not null").select("claim_id", "quote", "source_url", F.lower(F.trim("source_title")).alias("title"))
    pages = table(spark, folder, "fetch_results").select("url", F.lower(F.trim("title")).alias("title"), "text")
    titled = pages.select("title", "text").union(table(spark, folder, "documents").select(F.lower(F.trim("title")), "text"))
    # an address and a title are never the same key
    by_url, by_title = F.concat(F.lit("url "), "source_url"), F.concat(F.lit("title "), "title")
    quotes = rows.select(F.col("claim_id").alias("id"), F.explode(F.array(by_url, F.when(F.col("title") != "", by_title))).alias("key"), "quote")
    texts = pages.select(F.concat(F.lit("url "), "url").alias("key"), "text").union(titled.select(by_title, "text"))
    found = DOC.verified_quotes(quotes, texts).withColumnRenamed("id", "claim_id")
    return rows.join(found.withColumn("found", F.lit(True)), "claim_id", "left").select("claim_id", F.coalesce("found", F.lit(False)).alias("verified"))


@_query(
    "source_kinds",
    """
select fetch_id, case when starts_with(lower(trim(url)), '/') or starts_with(lower(trim(url)), '.') then 'local'
  when contains(lower(trim(url)), 'youtube.com') or contains(lower(trim(url)), 'youtu.be') then 'youtube'
  when ends_with(lower(trim(url)), '.pdf') or contains(lower(trim(url)), 'drive.google.com') then 'pdf' else 'blog' end as kind,
  coalesce(nullif(regexp_extract(url, '(?:v=|/v/|youtu\\.be/)([a-zA-Z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, 'embed/([a-zA-Z0-9_-]{11})', 1), '')) as video
from fetch_results
""",
)
def source_kinds(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "fetch_results").select("fetch_id", T.source_kind(url).alias("kind"), T.video_id(url).alias("video"))


@_query("non_empty_sources", r"select fetch_id from fetch_results where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100")
def non_empty_sources(spark: SparkSession, folder: str) -> DataFrame:
    return DOC.non_empty(table(spark, folder, "fetch_results")).select("fetch_id")


@_query(
    "chunks",
    """with recursive w as (
  select doc_id, text, 0 as k, 0::bigint as a, case when length(text) <= 8000 then length(text) else 8000 end as b from documents where text is not null
  union all
  select doc_id, text, k + 1, b - 500, b - 500 + 8000 from (
    select doc_id, text, k, a, coalesce(cut, b) as b from (
      select *, case when b < length(text) and strpos(reverse(substring(text, b - 499, 500)), chr(10) || chr(10)) > 0
          and b - 500 + length(substring(text, b - 499, 500)) - strpos(reverse(substring(text, b - 499, 500)), chr(10) || chr(10)) - 1 > a
        then b - 500 + length(substring(text, b - 499, 500)) - strpos(reverse(substring(text, b - 499, 500)), chr(10) || chr(10)) - 1 end as cut from w))
  where length(text) > 8000 and b - 500 < length(text)
), cut as (
  select doc_id, k, a, length(text) as n, text, case when b < length(text) and strpos(reverse(substring(text, b - 499, 500)), chr(10) || chr(10)) > 0
          and b - 500 + length(substring(text, b - 499, 500)) - strpos(reverse(substring(text, b - 499, 500)), chr(10) || chr(10)) - 1 > a
        then b - 500 + length(substring(text, b - 499, 500)) - strpos(reverse(substring(text, b - 499, 500)), chr(10) || chr(10)) - 1 else b end as b from w
)
select doc_id, k as chunk_index, a as start, least(b, n) as end, sha256(substring(text, a + 1, least(b, n) - a)) as chunk from cut
""",
)
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 8,000 characters over every document."""
    return DOC.chunk_documents(table(spark, folder, "documents")).withColumn("chunk", T.content_hash(F.col("chunk")))


@_query(
    "transcripts",
    r"""
select fetch_id as source_id, string_agg(said, ' ' order by start, said) as text, max(start)::double as duration from (
  select fetch_id, regexp_extract(line, '^\s*\[(\d+):(\d\d)\]\s*(.*)$', 1)::bigint * 60 + regexp_extract(line, '^\s*\[(\d+):(\d\d)\]\s*(.*)$', 2)::bigint as start,
    regexp_extract(line, '^\s*\[(\d+):(\d\d)\]\s*(.*)$', 3) as said
  from (select fetch_id, unnest(string_split(text, chr(10))) as line from (select fetch_id, any_value(text) as text from fetch_results group by 1))
  where regexp_matches(line, '^\s*\[\d+:\d\d\]\s*.*$')) group by 1
""",
)
def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched transcripts rebuilt from their timed lines."""
    lines = DOC.timed_segments(table(spark, folder, "fetch_results").dropDuplicates(["fetch_id"])).withColumn("duration", F.lit(0.0))
    return DOC.transcripts(lines).select("source_id", "text", "duration")


@_query("capped_claims", f"{_CLAIMS} select claim_id, source_url, row_number() over (partition by source_url order by ord) as rank from claims_v qualify rank <= 50")
def capped_claims(spark: SparkSession, folder: str) -> DataFrame:
    return DOC.first_per_source(extractions_view(spark, folder)).select("claim_id", "source_url", "rank")


@_query(
    "source_quality",
    """
select url, max(round(least(1.0, 0.5 + case when coalesce(credibility_signals.peer_reviewed, false) then 0.2 else 0 end
  + case when coalesce(credibility_signals.citation_count, 0) > 100 then 0.2 when coalesce(credibility_signals.citation_count, 0) > 10 then 0.1 else 0 end
  + case when coalesce(credibility_signals.author_h_index, 0) > 20 then 0.1 else 0 end), 6)::double) as quality from source_registry group by 1
""",
)
def source_quality(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("credibility_signals")
    quality = scoring.source_quality(s["peer_reviewed"], s["citation_count"], s["author_h_index"])
    return registry_view(spark, folder).groupBy("url").agg(F.max(F.round(quality, 6)).alias("quality"))


@_query(
    "quote_wilson",
    f"""{_CLAIMS}, t as (select source_url, count_if(quote_verified)::double as s, count(*)::double as n from claims_v group by 1)
select source_url, round(greatest(0.0, (s/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt((s/n)*(1-s/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) as lower,
       round(least(1.0, (s/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt((s/n)*(1-s/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) as upper from t
""",
)
def quote_wilson(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the share of verified quotes per source."""
    rows = extractions_view(spark, folder).groupBy("source_url").agg(F.count_if("quote_verified").alias("s"), F.count(F.lit(1)).alias("n"))
    w = scoring.wilson(F.col("s"), F.col("n"))
    return rows.select("source_url", F.round(w["lower"], 6).alias("lower"), F.round(w["upper"], 6).alias("upper"))


@_query(
    "model_agreement",
    f"""{_CLAIMS} select source_url, round(count_if(quote_verified) / count(*) * case when count(distinct regexp_extract(extraction_model, '^([^/-]*)', 1)) <= 1 then 0.7 else 1.0 end, 6) as agreement
from claims_v group by 1""",
)
def model_agreement(spark: SparkSession, folder: str) -> DataFrame:
    rows = extractions_view(spark, folder).groupBy("source_url").agg(
        F.count_if("quote_verified").alias("s"), F.count(F.lit(1)).alias("n"), F.count_distinct(scoring.model_family(F.col("extraction_model"))).alias("f")
    )
    return rows.select("source_url", F.round(scoring.agreement(F.col("s"), F.col("n"), F.col("f")), 6).alias("agreement"))


def _paired_vectors(spark: SparkSession, folder: str) -> DataFrame:
    claims = claims_view(spark, folder).where("status = 'active'").select(F.col("claim_id").alias("id"), "ord", "source_url")
    return vectors_view(spark, folder).join(claims, "id")


_PAIRS = f"""{_CLAIMS}, v as (
  select id, any_value(vector) as x from (select regexp_replace(lower(claim_id), '^\\s+|\\s+$', '', 'g') as id, vector from claim_vectors
    where len(vector) = 64 and len(list_filter(vector, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(vector, lambda e: e <> 0)) > 0) group by 1
), u as (select v.id, c.ord, c.source_url, x::double[] as x from v join active_v c on c.claim_id = v.id),
pairs as (
  select a.id as a, b.id as b, a.ord as ao, b.ord as bo, round(list_cosine_similarity(a.x, b.x), 6) as similarity, coalesce(a.source_url, '') <> coalesce(b.source_url, '') as cross_source
  from u a join u b on a.ord < b.ord
  where list_cosine_similarity(a.x, b.x) >= case when coalesce(a.source_url, '') <> coalesce(b.source_url, '') then 0.4 else 0.6 end
), best as (
  select *, row_number() over (order by cross_source desc, similarity desc, ao, bo) as rank from pairs qualify rank <= (select 5 * count(*) from u)
)"""


@_query("candidate_pairs", f"{_PAIRS} select a, b, similarity, cross_source, rank from best")
def candidate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs to classify: cosine of 0.4 across sources, 0.6 within, best five per claim overall."""
    return S.candidate_pairs(_paired_vectors(spark, folder))


@_query("pair_batches", f"{_PAIRS} select a, b, (rank - 1) // 15 as batch, ((rank - 1) % 15)::bigint as place from best")
def pair_batches(spark: SparkSession, folder: str) -> DataFrame:
    return S.batches(candidate_pairs(spark, folder)).select("a", "b", "batch", F.col("place").cast("bigint").alias("place"))


@_query(
    "dedup_leaders",
    f"""{_PAIRS.replace("with recursive", "with recursive", 1)}
, near as (select b.ord as late, list(a.ord) as early from u a join u b on a.ord < b.ord where list_cosine_similarity(a.x, b.x) >= 0.92 group by 1)
, turns as (select ord, row_number() over (order by ord) as k, coalesce(early, []) as early from u left join near on late = ord)
, led as (
  select 0::bigint as k, []::bigint[] as leaders
  union all select t.k, case when len(list_intersect(t.early, led.leaders)) = 0 then list_append(led.leaders, t.ord) else led.leaders end from led join turns t on t.k = led.k + 1
), final as (select leaders from led order by k desc limit 1)
select me.id as claim_id, coalesce(lead.id, me.id) as leader from turns t join u me on me.ord = t.ord
left join u lead on lead.ord = case when not list_contains((select leaders from final), t.ord) then list_min(list_intersect(t.early, (select leaders from final))) end
""",
)
def dedup_leaders(spark: SparkSession, folder: str) -> DataFrame:
    """Claims merged greedily at a cosine of 0.92."""
    vectors = _paired_vectors(spark, folder)
    leaders = S.duplicate_leaders(S.similar_pairs(vectors, 0.92, 0.92), vectors)
    return leaders.select(F.col("id").alias("claim_id"), "leader")


@_query("in_degree", f"{_EDGES} select target as claim_id, count(*) as in_degree from edges_v where edge_type in ('supports', 'depends_on', 'is_crux_for') and source is not null and target is not null group by 1")
def in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.in_degrees(edges_view(spark, folder))


_CASCADE = ", cas as (select distinct source, target from edges_v where edge_type in ('supports', 'depends_on', 'is_crux_for') and source is not null and target is not null)"
_TARGETS = """, goals as (select distinct target as claim_id from edges_v where edge_type = 'is_crux_for' and source is not null and target is not null)
, useful as (select claim_id as node from goals union select source from cas join useful on target = node)"""


def _targets(edges: DataFrame) -> DataFrame:
    """What cruxes point at."""
    return G.active_edges(edges, ("is_crux_for",)).select(F.col("target").alias("claim_id")).distinct()


@_query("reach_targets", f"{_EDGES} {_CASCADE} {_TARGETS} select distinct node from useful")
def reach_targets(spark: SparkSession, folder: str) -> DataFrame:
    edges = edges_view(spark, folder)
    return G.reaching(G.active_edges(edges, G.CASCADE), _targets(edges).toDF("node"))


_CRUX = f"""{_BOTH} {_CASCADE} {_TARGETS}
, deg as (select target as node, count(*) as d from edges_v where edge_type in ('supports', 'depends_on', 'is_crux_for') and source is not null and target is not null group by 1)
, onward as (select source, target from cas where target in (select node from useful))
, unc as (select claim_id, ord, category, coalesce(confidence, 0.5) as p,
    case when coalesce(confidence, 0.5) > 0 and coalesce(confidence, 0.5) < 1 then -(coalesce(confidence, 0.5) * log2(coalesce(confidence, 0.5)) + (1 - coalesce(confidence, 0.5)) * log2(1 - coalesce(confidence, 0.5))) else 0 end as h from active_v)
, elig as (select * from unc where category <> 'assessment' and h >= 0.001 and claim_id not in (select claim_id from goals))
, walk as (
  select claim_id as root, target as node, 1 as depth from elig join onward on source = claim_id
  union select w.root, o.target, w.depth + 1 from walk w join onward o on o.source = w.node where w.depth < 20
), sent as (select root, node, min(depth) as depth from walk where node <> root group by 1, 2)
, infl as (select root, sum(power(0.7, depth) / greatest(1, coalesce(d, 1))) / (select greatest(1, count(*)) from goals) as influence from sent left join deg using (node) group by 1)
, crux as (select u.claim_id, u.ord, round(u.h, 6) as uncertainty, round(coalesce(i.influence, 0), 6) as influence,
    round(case when e.claim_id is not null then u.h * coalesce(i.influence, 0) else 0 end, 6) as score
  from unc u left join infl i on i.root = u.claim_id left join elig e on e.claim_id = u.claim_id)"""


@_query("crux_scores", f"{_CRUX} select * from crux")
def crux_scores(spark: SparkSession, folder: str) -> DataFrame:
    claims, edges = graph_views(spark, folder)
    return G.crux_scores(claims, edges, _targets(edges))


@_query("top_cruxes", f"{_CRUX} select claim_id, score from crux where score > 0 order by score desc, ord limit 10")
def top_cruxes(spark: SparkSession, folder: str) -> DataFrame:
    claims, edges = graph_views(spark, folder)
    return G.top_cruxes(G.crux_scores(claims, edges, _targets(edges)), claims).select("claim_id", "score")


@_query(
    "settling",
    f"""{_BOTH}, verd as (select claim_id as v from active_v where {" or ".join(f"contains(lower(text), '{m}')" for m in T.VERDICT_MARKERS)})
, sup as (select source, target from edges_v where edge_type = 'supports' and source is not null and target is not null)
, wrong as (select v from verd where v in (select source from sup) and v not in (select target from sup))
, turned as (select case when e.edge_type = 'supports' and w.v is not null then e.target else e.source end as source,
    case when e.edge_type = 'supports' and w.v is not null then e.source else e.target end as target, e.edge_type from edges_v e left join wrong w on w.v = e.source)
, up as (select distinct source, target from turned where edge_type in ('supports', 'depends_on') and source is not null and target is not null and source <> target)
, near as (select v, v as node from verd union select v, up.source from near join up on up.target = node)
, conf as (select claim_id as node, coalesce(confidence, 0.5) as c from claims_v)
, deps as (select n.v, n.node, coalesce(c, 0.5) between 0.3 and 0.7 as contested from near n left join conf on conf.node = n.node where n.node <> n.v)
, crux as (select distinct n.v, e.source as node from turned e join near n on n.node in (e.source, e.target) left join conf on conf.node = e.source
    where e.edge_type = 'is_crux_for' and e.source is not null and e.target is not null and coalesce(c, 0.5) < 0.85)
, framed as (select node, count(*) as frames from (select source as node from turned where edge_type = 'frames_differently' and source is not null and target is not null
    union all select target from turned where edge_type = 'frames_differently' and source is not null and target is not null) group by 1)
, a as (select v, count(*) as n_dependencies, count_if(contested) as n_contested, coalesce(sum(frames), 0)::bigint as n_framework from deps left join framed using (node) group by 1)
, b as (select v, count(*) as n_cruxes from crux group by 1)
, o as (select v, count(*) as n_open from (select v, node from deps where contested union select v, node from crux) group by 1)
, n as (select verd.v, coalesce(n_dependencies, 0) as n_dependencies, coalesce(n_contested, 0) as n_contested, coalesce(n_cruxes, 0) as n_cruxes, coalesce(n_framework, 0) as n_framework,
    least(1.0, coalesce(n_open, 0) / greatest(1, coalesce(n_dependencies, 0))) as base from verd left join a using (v) left join b using (v) left join o using (v))
select v as verdict_id, n_contested + n_cruxes > 0 or n_framework > 0 as detected, n_dependencies, n_contested, n_cruxes, n_framework,
  round(case when n_framework > 0 then greatest(0.5, base) when n_contested + n_cruxes > 0 then base else 0 end, 6)::double as severity from n
""",
)
def settling(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict claims given while what they rest on is open."""
    claims, edges = graph_views(spark, folder)
    verdicts = G.verdict_claims(claims)
    return G.settling(claims, G.turned_edges(edges, verdicts), verdicts)


@_query("verdict_claims", f"{_CLAIMS} select claim_id from active_v where (" + " or ".join(f"contains(lower(text), '{m}')" for m in T.VERDICT_MARKERS) + ")")
def verdict_claims(spark: SparkSession, folder: str) -> DataFrame:
    return G.verdict_claims(claims_view(spark, folder))


_POSITIONS = f""", {POSITIONS_SQL}
, pe as (select least(p.position_id, q.position_id) as a, greatest(p.position_id, q.position_id) as b, edge_type
  from edges_v e join member p on p.claim_id = e.source join member q on q.claim_id = e.target where p.position_id <> q.position_id)
, pc as (select a, b, count(*) as edges, count_if(edge_type = 'supports') as supports, count_if(edge_type = 'contradicts') as contradicts, count_if(edge_type = 'frames_differently') as frames from pe group by 1, 2)"""


@_query(
    "position_disagreement",
    f"""{_BOTH} {_POSITIONS}, ids as (select distinct position_id from member)
select x.position_id as a, y.position_id as b, coalesce(contradicts, 0) as contradicts, coalesce(frames, 0) as frames,
  case when coalesce(contradicts, 0) + coalesce(frames, 0) = 0 then 'unknown' when frames > contradicts then 'framework' else 'factual' end as kind
from ids x join ids y on x.position_id < y.position_id left join pc on pc.a = x.position_id and pc.b = y.position_id
""",
)
def position_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    return D.disagreements(positions_view(spark, folder), edges_view(spark, folder))


@_query("position_support_share", f"{_BOTH} {_POSITIONS} select a, b, edges, round(supports / edges, 6) as share from pc")
def position_support_share(spark: SparkSession, folder: str) -> DataFrame:
    return D.support_shares(positions_view(spark, folder), edges_view(spark, folder))


@_query("merged_positions")
def merged_positions(spark: SparkSession, folder: str) -> DataFrame:
    return D.merge_positions(positions_view(spark, folder), edges_view(spark, folder))


@_query(
    "opposing_position",
    f"""{_BOTH} {_POSITIONS}, largest as (select position_id from member group by 1 order by count(distinct claim_id) desc, position_id limit 1)
, inside as (select distinct claim_id from member where position_id in (select position_id from largest))
, ag as (select source, target from edges_v where edge_type in ('contradicts', 'frames_differently', 'qualifies') and source is not null and target is not null)
, foes as (select distinct o as claim_id from (select source as i, target as o from ag union all select target, source from ag)
   where i in (select claim_id from inside) and o not in (select claim_id from inside))
, sup as (select source, target from edges_v where edge_type = 'supports' and source is not null and target is not null)
, all_foes as (select claim_id from foes union select source from sup where target in (select claim_id from foes) union select target from sup where source in (select claim_id from foes))
, free as (select claim_id from all_foes where claim_id not in (select claim_id from member))
select claim_id from free where (select count(*) from free) >= 3
""",
)
def opposing_position(spark: SparkSession, folder: str) -> DataFrame:
    """The opposition to the largest of the stated positions."""
    return D.opposing_position(positions_view(spark, folder), edges_view(spark, folder))


@_query("positions_density")
def positions_density(spark: SparkSession, folder: str) -> DataFrame:
    """Density clusters of the claims of each case of the source registry."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"/+$", "")
    cases = registry_view(spark, folder).select(plain("url").alias("_url"), "case_name").where("case_name is not null").dropDuplicates(["_url"])
    vectors = _paired_vectors(spark, folder).withColumn("_url", plain("source_url")).join(cases, "_url")
    return D.density_positions(vectors)


@_query(
    "midband_sample",
    f"{_CLAIMS} select claim_id, confidence from claims_v order by round(abs(coalesce(confidence, 0.5) - 0.5), 9), ord limit (select greatest(1, floor(count(*) * 0.1))::bigint from claims_v)",
)
def midband_sample(spark: SparkSession, folder: str) -> DataFrame:
    from loomgraph.operators.providers import mid_band

    return mid_band(claims_view(spark, folder)).select("claim_id", "confidence")


@_query(
    "graph_stats",
    f"""{_BOTH} select 'category' as section, category as name, count(*) as n from active_v group by 2
union all select 'edge_type', edge_type, count(*) from edges_v group by 2
union all select 'total', 'claims', count(*) from active_v union all select 'total', 'sources', count(distinct source_title) from active_v""",
)
def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    return R.graph_counts(*graph_views(spark, folder))


@_query(
    "claim_page_links",
    f"""{_BOTH} {_POSITIONS}, i as (select target as claim_id, count_if(edge_type = 'supports') as supporting, count_if(edge_type = 'contradicts') as contradicting from edges_v group by 1)
select c.claim_id, coalesce(supporting, 0) as supporting, coalesce(contradicting, 0) as contradicting, coalesce(positions, 0) as positions from claims_v c left join i on i.claim_id = c.claim_id left join (select claim_id, count(distinct position_id) as positions from member group by 1) m on m.claim_id = c.claim_id""",
)
def claim_page_links(spark: SparkSession, folder: str) -> DataFrame:
    return R.claim_page_links(*graph_views(spark, folder), positions_view(spark, folder))


@_query("unsupported_claims", f"{_BOTH} select claim_id from active_v where claim_id not in (select target from edges_v where edge_type = 'supports' and source is not null and target is not null)")
def unsupported_claims(spark: SparkSession, folder: str) -> DataFrame:
    return G.unsupported_claims(*graph_views(spark, folder))


@_query("open_contradictions", f"{_BOTH} select edge_id, source, target from edges_v where edge_type = 'contradicts' and source in (select claim_id from active_v) and target in (select claim_id from active_v)")
def open_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    return G.open_contradictions(*graph_views(spark, folder))


@_query("adjacency", f"{_BOTH}, o as (select source, count(*) as n_out from edges_v group by 1) select claim_id, coalesce(n_out, 0) as n_out from claims_v left join o on source = claim_id")
def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.adjacency(*graph_views(spark, folder))
    return rows.select("claim_id", F.coalesce(F.size(F.filter("out_edges", lambda x: x.isNotNull())), F.lit(0)).alias("n_out"))


@_query("dependency_cycles", f"{_EDGES}, dep as (select distinct source, target from edges_v where edge_type = 'depends_on' and source is not null and target is not null), w as (select source as r, target as n from dep union select r, target from w join dep on source = n) select distinct r as node from w where r = n")
def dependency_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return G.on_dependency_cycle(edges_view(spark, folder))


@_query("pending_sources", f"{_CLAIMS} select url from source_registry where url not in (select source_url from claims_v where source_url is not null)")
def pending_sources(spark: SparkSession, folder: str) -> DataFrame:
    return R.pending_sources(registry_view(spark, folder), extractions_view(spark, folder)).select("url")


@_query("extraction_usage", f"{_CLAIMS} select extraction_model as model, count(*) as calls, sum(length(text))::bigint as input_tokens, sum(length(coalesce(quote, '')))::bigint as output_tokens from claims_v group by rollup (extraction_model)")
def extraction_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Characters read and quoted by extraction model, with the total."""
    rows = extractions_view(spark, folder).select(F.col("extraction_model").alias("model"), F.length("text").cast("bigint").alias("input_tokens"), F.length(F.coalesce("quote", F.lit(""))).cast("bigint").alias("output_tokens"))
    return R.usage_rollup(rows)


@_query("trial_scores", f"{_CLAIMS}, t as (select category, count_if(quote_verified)::double s, count(*)::double n from claims_v group by 1) select category, round(s / n, 6) as point, case when (s/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt((s/n)*(1-s/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n) > 0.8 then 'HIGH' when (s/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt((s/n)*(1-s/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n) > 0.5 then 'MEDIUM' when (s/n + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt((s/n)*(1-s/n)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n) > 0.2 then 'LOW' else 'INSUFFICIENT_EVIDENCE' end as label from t")
def trial_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Verification trials by category: point estimate and label of the interval."""
    rows = extractions_view(spark, folder).groupBy("category").agg(F.count_if("quote_verified").alias("s"), F.count(F.lit(1)).alias("n"))
    w = scoring.wilson(F.col("s"), F.col("n"))
    return rows.select("category", F.round(F.col("s") / F.col("n"), 6).alias("point"), scoring.interval_label(w["lower"], F.lit(1.0)).alias("label"))


@_query("verifiable_claims", f"{_CLAIMS} select claim_id from active_v where quote_verified")
def verifiable_claims(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.verifiable(claims_view(spark, folder)).select("claim_id")


@_query("average_confidence", f"{_BOTH} {_SCORED} select count(*) as claims, round(coalesce(avg(confidence), 0), 3) as confidence from scored")
def average_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return R.average_confidence(claim_confidence(spark, folder))


@_query("level_counts", f"{_BOTH} {_SCORED} select level, count(*) as n from scored group by 1")
def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.level_counts(claim_confidence(spark, folder))


@_query("source_names", f"{_CLAIMS} select distinct source_title from active_v where source_title is not null")
def source_names(spark: SparkSession, folder: str) -> DataFrame:
    return R.source_names(claims_view(spark, folder))


@_query("position_members", f"""with {POSITIONS_SQL.replace("select p.position_id, ", "select p.position_id, p.ord, ").replace("select position_id, unnest(last.members) as m", "select position_id, unnest(last.members) as m, unnest(range(len(last.members))) as ord")}
, placed as (select position_id, claim_id, row_number() over (partition by position_id order by ord, claim_id) as place from member)
select position_id, claim_id, place::int as place, place <= 15 as open from placed""")
def position_members(spark: SparkSession, folder: str) -> DataFrame:
    return R.members_shown(positions_view(spark, folder))


@_query("claim_links", f"""{_BOTH} {_POSITIONS}, l as (
  select target as claim_id, edge_type as kind, source as other from edges_v where edge_type in ('supports', 'contradicts') and source is not null
  union select claim_id, 'position', position_id from member)
select claim_id, kind, other from l where claim_id in (select claim_id from claims_v)""")
def claim_links(spark: SparkSession, folder: str) -> DataFrame:
    return R.claim_links(*graph_views(spark, folder), positions_view(spark, folder))


@_query("contradiction_texts", f"""{_BOTH} select e.edge_id, length(a.text) + length(b.text) as letters from edges_v e join claims_v a on a.claim_id = e.source join claims_v b on b.claim_id = e.target where e.edge_type = 'contradicts'""")
def contradiction_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Contradictions with the size of what a reader would be shown to confirm them."""
    claims, edges = graph_views(spark, folder)
    rows = prompts.with_texts(edges.where("status = 'active' and edge_type = 'contradicts'"), claims, "source", "target")
    return rows.select("edge_id", (F.length("source_text") + F.length("target_text")).alias("letters"))


@_query("grey_zone_pairs", f"""{_PAIRS} select a.id as a, b.id as b from u a join u b on a.ord < b.ord where list_cosine_similarity(a.x, b.x) >= 0.8 and list_cosine_similarity(a.x, b.x) < 0.92""")
def grey_zone_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that may or may not be duplicates and are asked about."""
    return S.grey_zone(_paired_vectors(spark, folder))


@_query("merge_events", ORACLE["dedup_leaders"].replace("select me.id as claim_id, coalesce(lead.id, me.id) as leader from", "select me.id as old_claim_id, lead.id as merged_into from") + " where lead.id is not null")
def merge_events(spark: SparkSession, folder: str) -> DataFrame:
    """Supersessions that the merging of duplicates writes to the log."""
    leaders = dedup_leaders(spark, folder).select(F.col("claim_id").alias("id"), "leader", F.regexp_extract("claim_id", r"(\d+)$", 1).cast("bigint").alias("ord"))
    return writers.merges(leaders).select(F.get_json_object("payload", "$.old_claim_id").alias("old_claim_id"), F.get_json_object("payload", "$.merged_into").alias("merged_into"))


@_query("settling_flags", ORACLE["settling"].replace("from n\n", "from n where n_contested + n_cruxes > 0 or n_framework > 0\n").replace("select v as verdict_id, n_contested + n_cruxes > 0 or n_framework > 0 as detected, n_dependencies, n_contested, n_cruxes, n_framework,", "select v as verdict_id, n_dependencies as dependency_count, case when n_framework = 0 then 1 when n_contested + n_cruxes = 0 then 1 else 2 end as kinds,").replace("round(case when", "round_even(case when").replace(", 6)::double as severity", ", 3)::double as severity"))
def settling_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags that the settling check writes to the log."""
    flags = writers.settling_flags(settling(spark, folder), extractions_view(spark, folder))
    body = F.from_json("payload", "verdict_claim_id string, dependency_count bigint, settling_type array<string>, severity double")
    return flags.select(body.alias("b")).select(F.col("b.verdict_claim_id").alias("verdict_id"), "b.dependency_count", F.size("b.settling_type").alias("kinds"), "b.severity")

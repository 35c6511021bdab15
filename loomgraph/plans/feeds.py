"""Queries over the change feed: current state and supersession hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.changefeed import active_entities, rebuild_state
from loomgraph.operators.hierarchy import descendant_pairs, resolve_hierarchy, supersession_links
from loomgraph.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every active claim and edge with its latest assertion and patch."""
    return active_entities(rebuild_state(table(spark, folder, "event_log"), with_body=False))


def p1_state(spark: SparkSession, folder: str) -> DataFrame:
    """The rebuilt state with bodies, tombstones included."""
    return rebuild_state(table(spark, folder, "event_log"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every event that supersedes another."""
    links = supersession_links(table(spark, folder, "event_log"))
    tree = resolve_hierarchy(links)
    # tops of trees supersede nothing; every other node is one of the events asked for
    return tree.where("depth <> 0").select(F.col("node").alias("event_id"), F.col("root").alias("root_id"), "depth")


def p7_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth, full path and number of descendants of every linked event."""
    tree = resolve_hierarchy(supersession_links(table(spark, folder, "event_log")), with_paths=True)
    return tree.select(
        F.col("node").alias("event_id"), F.col("root").alias("root_id"), "depth", "loop",
        F.array_join("path", ">").alias("path"), F.when(~F.col("loop"), F.col("n_descendants")).alias("n_descendants"),
    )


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with each event below it and the steps between them."""
    return descendant_pairs(resolve_hierarchy(supersession_links(table(spark, folder, "event_log")), with_paths=True))


QUERIES = {"p1_found": p1_found, "p1_state": p1_state, "p7_found": p7_found, "p7_tree": p7_tree, "p7_descendants": p7_descendants}

_BARE = "nullif(regexp_replace(lower({}), '^\\s+|\\s+$', '', 'g'), '')"


def _bare(column: str) -> str:
    return _BARE.format(column)


_EFFECTS = f"""
with ev as (
  select {_bare('event_type')} as kind, tx, {_bare('supersedes')} as ref, payload as full_body, epoch_us(ts) as moment,
         case when json_valid(payload) then payload end as body
  from event_log where tx is not null
), own as (
  select kind, tx, ref, full_body, moment, json_extract_string(body, '$.confidence') as conf, {_bare("json_extract_string(body, '$.claim_id')")} as claim_id,
         {_bare("json_extract_string(body, '$.edge_id')")} as edge_id,
         {_bare("json_extract_string(body, '$.old_claim_id')")} as old_id
  from ev
), births as (
  select claim_id as id, max(tx) as tx, 'claim' as what from own where kind = 'claim.asserted' and claim_id is not null group by 1
  union all
  select edge_id, max(tx), 'edge' from own where kind = 'edge.asserted' and edge_id is not null group by 1
), deaths as (
  select id, max(seq) as seq from (
    select ref as id, 2 * tx as seq from own where ref is not null
    union all select old_id, 2 * tx + 1 from own where kind = 'claim.superseded' and old_id is not null
  ) group by 1
), patches as (
  select claim_id as id, max(tx) as tx from own where kind = 'claim.rank_changed' and claim_id is not null group by 1
)
"""

_WALK = f"""
with recursive ids as (select distinct {_bare('event_id')} as id from event_log),
links as (
  select {_bare('event_id')} as child, min({_bare('supersedes')}) as parent from event_log
  where {_bare('supersedes')} in (select id from ids) group by 1
), walk as (
  select child as event_id, parent as spot, 1 as depth, child || '>' || parent as path from links
  union all
  select w.event_id, l.parent, w.depth + 1, case when w.depth < 200 then w.path || '>' || l.parent end from walk w join links l on l.child = w.spot
  where w.depth <= 2 * (select count(*) from links)
), ends as (
  select event_id, spot, depth, path from walk where spot not in (select child from links)
), looping as (select child from links where child not in (select event_id from ends)),
loops as (
  select event_id, min(spot) as root_id from walk
  where event_id in (select child from looping) and depth > (select count(*) from links) group by 1
)
"""

ORACLE = {
    "p1_found": _EFFECTS
    + """
select b.id as entity_id, b.tx as assert_tx,
       case when b.what = 'claim' and p.tx > b.tx then p.tx else 0 end as patch_tx
from births b left join deaths d on d.id = b.id left join patches p on p.id = b.id
where d.seq is null or d.seq < 2 * b.tx + 1
""",
    "p1_state": _EFFECTS
    + """
, named as (select id, any_value(what) as what, max(tx) as tx from births group by 1),
bodies as (
  select coalesce(case when kind = 'claim.asserted' then claim_id else edge_id end) as id, tx, max(full_body) as body, arg_max(moment, full_body) as moment
  from own where kind in ('claim.asserted', 'edge.asserted') group by 1, 2
), said as (select claim_id as id, max({'tx': tx, 'body': full_body}) as m from own where kind = 'claim.rank_changed' and claim_id is not null group by 1),
scored as (
  select claim_id as id, max({'tx': tx, 'conf': conf}) as m from own
  where kind = 'claim.rank_changed' and claim_id is not null and try_cast(conf as double) is not null group by 1
), refs as (select ref as id, max({'seq': 2 * tx, 'moment': moment}) as d from own where ref is not null group by 1),
olds as (select old_id as id, max({'seq': 2 * tx + 1, 'moment': moment}) as d from own where kind = 'claim.superseded' and old_id is not null group by 1),
every as (select id from named union select id from refs union select id from olds union select id from said)
select e.id as entity_id, n.what as entity_kind, coalesce(2 * n.tx + 1, -1) as insert_seq, b.body as insert_body,
  case when n.what = 'claim' and s.m.tx > n.tx then 2 * s.m.tx + 1 end as patch_seq, case when n.what = 'claim' and s.m.tx > n.tx then s.m.body end as patch_body,
  nullif(greatest(coalesce(r.d.seq, -1), case when n.what = 'edge' then -1 else coalesce(o.d.seq, -1) end), -1) as delete_seq,
  n.tx is not null and 2 * n.tx + 1 > coalesce(r.d.seq, -1) and (n.what <> 'claim' or 2 * n.tx + 1 > coalesce(o.d.seq, -1)) as active,
  case when n.what = 'claim' and c.m.tx > n.tx then c.m.conf end as score_body, b.moment as insert_at,
  case when n.what is distinct from 'edge' and coalesce(o.d.seq, -1) > coalesce(r.d.seq, -1) then o.d.moment else r.d.moment end as delete_at
from every e left join named n on n.id = e.id left join bodies b on b.id = n.id and b.tx = n.tx left join said s on s.id = e.id
left join scored c on c.id = e.id left join refs r on r.id = e.id left join olds o on o.id = e.id
""",
    "p7_found": _WALK
    + """
select event_id, spot as root_id, depth::bigint as depth from ends
union all select event_id, root_id, -1 from loops
""",
    "p7_tree": _WALK
    + """
, below as (select spot as id, count(*) as n from walk where event_id in (select event_id from ends) group by 1)
select e.event_id, e.spot as root_id, e.depth::bigint as depth, false as loop, e.path, coalesce(n, 0) as n_descendants from ends e left join below on id = e.event_id
union all select event_id, root_id, -1, true, null, null from loops
union all select id, id, 0, false, id, n from below where id not in (select child from links)
""",
    "p7_descendants": _WALK
    + """
select spot as ancestor, event_id as descendant, depth::int as distance from walk where event_id in (select event_id from ends)
""",
}

"""Named queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.boilerplate import boilerplate_lines
from loomgraph.llm.chunking import split_oversized
from loomgraph.llm.clusters import describe_clusters, subject_clusters
from loomgraph.llm.components import consolidate, restatement_pairs
from loomgraph.llm.leakage import leaked_items
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from loomgraph.llm.vector_neighbours import greedy_search, neighbour_graph, similar_vectors, usable_vectors
from loomgraph.sources.tables import table


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims under plain ids."""
    return table(spark, folder, "extraction_results").withColumn("id", F.lower(F.trim("claim_id")))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "claim_vectors").select(F.lower(F.trim("claim_id")).alias("id"), "vector")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of claims of which one is among the other's five most similar."""
    near = similar_vectors(_vectors(spark, folder), dim=64, k=5)
    return near.select(F.least("a", "b").alias("claim_id_a"), F.greatest("a", "b").alias("claim_id_b")).distinct()


def p2_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar claims of every claim, with similarities."""
    near = similar_vectors(_vectors(spark, folder), dim=64, k=5)
    return near.select(F.col("a").alias("claim_id"), F.col("b").alias("similar_id"), F.round("similarity", 6).alias("similarity"), "rank")


def p2_search(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy graph search for the claims whose number is divisible by 20, against all."""
    units = usable_vectors(_vectors(spark, folder), 64)
    nodes, graph = neighbour_graph(units, 64)
    asked = nodes.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 20 == 0).select("id", "unit")
    near = greedy_search(asked, nodes, graph)
    return near.select(F.col("a").alias("claim_id"), F.col("b").alias("similar_id"), F.round("similarity", 6).alias("similarity"), "rank")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of fetched pages that are not part of the article."""
    pages = table(spark, folder, "fetch_results").select(F.col("fetch_id").alias("id"), "url", "text")
    return boilerplate_lines(pages).select(F.col("id").alias("fetch_id"), "line_no")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that share at least 0.7 of their words."""
    pairs = near_duplicate_pairs(_claims(spark, folder), ("natural_language", "relevant_quote"), 0.7)
    return pairs.select(F.col("id_a").alias("claim_id_a"), F.col("id_b").alias("claim_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every claim with its class of copies, its near-duplicate group and its links."""
    groups = near_duplicate_groups(_claims(spark, folder), ("natural_language", "relevant_quote"), 0.7)
    return groups.withColumnRenamed("id", "claim_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every claim that restates another, directly or through others."""
    groups = consolidate(restatement_pairs(table(spark, folder, "trace_edges")))
    return groups.select(F.col("member").alias("claim_id"), F.col("group").alias("group_id"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return subject_clusters(_claims(spark, folder).select("id", F.col("natural_language").alias("text")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that argue about one subject."""
    return _clusters(spark, folder).select(F.col("id").alias("claim_id"), "cluster_id")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and most typical claims of the clusters."""
    described = describe_clusters(_clusters(spark, folder))
    return described.select("cluster_id", "size", F.array_join("typical", " ").alias("typical"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item."""
    return p8_overlap(spark, folder).select("doc_id", "item_id")


def p8_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of an item leaked into a document, and how many of its closing question."""
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_leaked(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items by the number of documents that each leaked into."""
    found = p8_found(spark, folder)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The records chosen for the target mix, with the copies of each."""
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of more than 1,024 tokens: those that were split."""
    pieces = split_oversized(table(spark, folder, "documents"))
    return pieces.where("piece_no = 1").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized document."""
    return split_oversized(table(spark, folder, "documents"))


def p10_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For every document that was split: its tokens, and whether its pieces cover it, fit and overlap as asked."""
    pieces = split_oversized(table(spark, folder, "documents"))
    before = F.lag("end_token").over(Window.partitionBy("doc_id").orderBy("piece_no"))
    rows = pieces.withColumn("before", before)
    fits = F.col("end_token") - F.col("first_token") <= 1024
    overlaps = F.when(F.col("before").isNull(), F.col("first_token") == 0).otherwise(F.col("before") - F.col("first_token") == 64)
    return rows.groupBy("doc_id").agg(
        F.max("end_token").cast("bigint").alias("n_tokens"), F.bool_and(fits).alias("fits"), F.bool_and(overlaps).alias("overlaps"),
        F.bool_and(F.length("piece") > 0).alias("filled"),
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_similar": p2_similar,
    "p2_search": p2_search,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_clusters": p6_clusters,
    "p8_found": p8_found,
    "p8_leaked": p8_leaked,
    "p8_overlap": p8_overlap,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
    "p10_checks": p10_checks,
}

_PLAIN = r"regexp_replace(lower({}), '^\s+|\s+$', '', 'g')"
_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"

ORACLE = {
    "p4_found": """
with c as (
  select lower(trim(claim_id)) as id, min(coalesce(natural_language, '') || ' ' || coalesce(relevant_quote, '')) as t
  from extraction_results group by 1
), w as (select distinct id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) as word from c),
n as (select id, count(*) as n from w group by 1),
s as (select a.id as a, b.id as b, count(*) as k from w a join w b on a.word = b.word and a.id < b.id group by 1, 2)
select a as claim_id_a, b as claim_id_b from s join n na on na.id = a join n nb on nb.id = b
where k >= 0.7 * (na.n + nb.n - k) - 1e-9
""",
    "p5_found": f"""
with recursive e as (
  select {_PLAIN.format('source')} as a, {_PLAIN.format('target')} as b from trace_edges
  where {_PLAIN.format('edge_type')} in ('refines', 'supersedes')
), k as (
  select a, b from e where a <> b and a like 'clm\\_%' escape '\\' and b like 'clm\\_%' escape '\\'
), s as (select a, b from k union select b, a from k),
reach as (
  select a as claim_id, a as other from s union select claim_id, s.b from reach join s on s.a = other
)
select claim_id, min(other) as group_id from reach group by 1
""",
    "p8_found": f"""
with d as (select doc_id, {_WORDS} as w from documents where text is not null),
i as (select item_id, {_WORDS} as w from eval_items where text is not null),
dr as (select distinct doc_id, array_to_string(w[s:s+11], ' ') as r
       from (select doc_id, w, unnest(range(1, len(w) - 10)) as s from d)),
ir as (select distinct item_id, array_to_string(w[s:s+11], ' ') as r
       from (select item_id, w, unnest(range(1, len(w) - 10)) as s from i))
select distinct doc_id, item_id from dr join ir using (r)
""",
    "p10_found": r"""
select doc_id from documents
where len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+')) > 1024
""",
}
_N_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+'))"
ORACLE["p10_checks"] = f"select doc_id, {_N_TOKENS} as n_tokens, true as fits, true as overlaps, true as filled from documents where {_N_TOKENS} > 1024"
ORACLE["p9_shares"] = f"""
with d as (
  select regexp_replace(regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g'), '[\\s_]+', '_', 'g') as source, {_N_TOKENS} as n from documents where source is not null and text is not null
), t as (
  select regexp_replace(regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g'), '[\\s_]+', '_', 'g') as source, max(target_share) as target_share, max(max_repeats) as max_repeats from mix_targets group by 1
), h as (select t.*, coalesce((select sum(n) from d where d.source = t.source), 0)::bigint as tokens_held from t),
w as (select min(tokens_held * max_repeats / target_share) as whole from h where target_share > 0 and tokens_held > 0),
b as (select h.*, case when tokens_held > 0 then floor(whole * target_share + 1e-6)::bigint else 0 end as tokens_wanted from h, w)
select source, target_share, max_repeats, tokens_held, tokens_wanted, tokens_wanted as tokens_used, 0::bigint as tokens_short,
  tokens_wanted / (select sum(tokens_wanted) from b) as actual_share from b
"""
ORACLE["p4_groups"] = """
with recursive c as (
  select lower(trim(claim_id)) as id, min(coalesce(natural_language, '') || ' ' || coalesce(relevant_quote, '')) as t from extraction_results group by 1
), s as (select id, list_sort(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))) as ws from c),
k as (select ws, min(id) as class_id, count(*) as n_copies from s where len(ws) > 0 group by 1),
w as (select class_id, unnest(ws) as word, len(ws) as n from k),
p as (select a.class_id as a, b.class_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from w a join w b on a.word = b.word and a.class_id <> b.class_id group by 1, 2),
l as (select a, b from p where k >= 0.7 * (na + nb - k) - 1e-9),
r as (select class_id, class_id as other from k union select r.class_id, l.b from r join l on l.a = r.other),
g as (select class_id, min(other) as group_id from r group by 1),
m as (select a as class_id, count(*) as n_links from l group by 1)
select s.id as claim_id, k.class_id, g.group_id, coalesce(n_links, 0) as n_links, n_copies from s join k on k.ws = s.ws join g on g.class_id = k.class_id left join m on m.class_id = k.class_id
"""
ORACLE["p8_overlap"] = f"""
with d as (select doc_id, {_WORDS} as w from documents where text is not null),
i as (select item_id, {_WORDS} as w,
        len(case when ends_with(trim(text), '?') then regexp_extract_all(lower(regexp_extract(trim(text), '^(.*[.!?:])\\s[^.!?:]*[?]$', 1)), '[a-z0-9]+') else {_WORDS} end) as asks
      from eval_items where text is not null),
dr as (select distinct doc_id, array_to_string(w[s:s+11], ' ') as r
       from (select doc_id, w, unnest(range(1, len(w) - 10)) as s from d)),
ir as (select item_id, asks, s, array_to_string(w[s:s+11], ' ') as r
       from (select item_id, asks, w, unnest(range(1, len(w) - 10)) as s from i)),
hit as (select distinct doc_id, item_id, asks, unnest(range(s, s + 12)) as spot from dr join ir using (r))
select doc_id, item_id, count(*)::int as words, count_if(spot > asks)::int as question_words from hit group by 1, 2
"""
ORACLE["p8_leaked"] = f"select item_id, count(*) as n_docs, min(doc_id) as first_doc from ({ORACLE['p8_found']}) group by 1"

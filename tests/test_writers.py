import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import prompts, providers, store, writers
from loomgraph.operators import reports as R

CLAIM = "claim_id string, ord bigint, text string, quote string, quote_verified boolean, status string, confidence double, source_url string, source_title string"


@pytest.fixture()
def claims(spark):
    rows = [(f"clm_{k:03d}", k, f"text {k} " + "x" * 200, f"quote {k}", k % 2 == 0, "superseded" if k == 5 else "active", k / 100, f"u{k % 2}", ["B", "A", None][k % 3]) for k in range(60)]
    return spark.createDataFrame(rows, CLAIM)


def payloads(df):
    return [json.loads(r.payload) for r in df.orderBy("ord").collect()]


def test_what_is_written_changes_the_state(spark, rows, claims):
    made = spark.createDataFrame([(k, "claim.asserted", json.dumps({"claim_id": f"clm_{k:03d}", "confidence": 0.4})) for k in range(4)], "ord bigint, event_type string, payload string")
    made = made.unionByName(spark.createDataFrame([(9, "edge.asserted", '{"edge_id": "edg_000001", "edge_type": "contradicts", "source": "clm_000", "target": "clm_001"}')], made.schema))
    leaders = spark.createDataFrame([("clm_000", 0, "clm_000"), ("clm_001", 1, "clm_000")], "id string, ord bigint, leader string")
    updates = spark.createDataFrame([("clm_002", 2, 0.12345, "very_low", 1, "quote")], "claim_id string, ord bigint, confidence double, level string, clusters int, weakest string")
    flagged = spark.createDataFrame([("clm_003", "fabrication", 0.1), ("clm_002", "unsupported", None)], "claim_id string, verdict string, confidence double")
    revised = spark.createDataFrame([("edg_000001", "none", "clm_000", "clm_001", 0.5, "contradicts")], "edge_id string, edge_type string, source string, target string, strength double, revised_from string")
    parts = [writers.merges(leaders), writers.confidence_patches(updates), writers.entailment_patches(flagged, claims), writers.revised_edges(revised)]
    log = store.number_events(made)
    for part in parts:
        last = log.agg(F.max("tx")).first()[0]
        log = log.unionByName(store.number_events(part, last))
    log = log.withColumn("supersedes", F.lit(None).cast("string"))
    assert sorted(r.tx for r in log.collect()) == list(range(1, log.count() + 1))
    got = {r.claim_id: (r.status, r.confidence) for r in store.claim_state(log).collect()}
    assert got == {"clm_000": ("active", 0.4), "clm_001": ("superseded", 0.4), "clm_002": ("active", 0.123), "clm_003": ("active", 0.1)}
    assert rows(store.edge_state(log), "edge_type", "revised_from") == [("none", "contradicts")]
    assert store.flags(log).count() == 2


def test_flags_and_positions(spark, claims):
    settled = spark.createDataFrame([("clm_001", True, 4, 1, 0, 2, 0.66666), ("clm_002", False, 0, 0, 0, 0, 0.0)], "verdict_id string, detected boolean, n_dependencies bigint, n_contested bigint, n_cruxes bigint, n_framework bigint, severity double")
    assert payloads(writers.settling_flags(settled, claims)) == [{"flag_type": "settling", "verdict_claim_id": "clm_001", "settling_type": ["factual", "framework"], "severity": 0.667, "dependency_count": 4}]
    assert R.settling_report(settled).count() == 2
    (none,) = R.settling_report(settled.limit(0)).collect()
    assert (none.verdict_id, none.detected, none.n_dependencies) == (None, False, 0)
    positions = claims.where("ord < 8").select(F.lit("p").alias("position_id"), "claim_id", "ord", "confidence")
    labels = spark.createDataFrame([("p", "L", None, "clm_000")], "position_id string, label string, summary string, core_claim string")
    (said,) = payloads(writers.stated_positions(positions, labels))
    assert said["member_claims"] == [f"clm_{k:03d}" for k in range(8)] and said["strongest_claims"] == [f"clm_{k:03d}" for k in (7, 6, 5, 4, 3)] and said["label"] == "L"


def test_prompts_show_what_their_limits_allow(spark, claims):
    ask = lambda df: df.first().prompt
    chunk = spark.createDataFrame([(1, 0, "the text")], "doc_id int, chunk_index int, chunk string")
    assert ask(prompts.extraction(chunk)).endswith("\n\nthe text")
    assert prompts.entailment(claims).count() == 30 and prompts.verifiable(claims).count() == 30
    fallback = ask(prompts.positions(claims))
    assert fallback.count("\n") == 50 and "51." not in fallback and max(map(len, fallback.split("\n")[1:])) <= 104 and "text 5 " not in fallback
    held = claims.select(F.lit("p").alias("position_id"), "claim_id", "ord")
    assert ask(prompts.labels(held, claims)).count("\n") == 20
    batch = spark.createDataFrame([(0, 1, "clm_001", "clm_002"), (0, 0, "clm_003", "clm_004")], "batch int, place int, a string, b string")
    assert ask(prompts.relations(batch, claims)).split("\n")[1].startswith("1. A: text 3 ")
    assert "B: text 2 " in ask(prompts.same_claim(batch.where("place = 1").select("a", "b"), claims))
    edges = spark.createDataFrame([("e", "clm_001", "clm_002", "contradicts", "active"), ("f", "clm_001", "clm_002", "contradicts", "superseded")], "edge_id string, source string, target string, edge_type string, status string")
    assert prompts.contradictions(edges, claims).count() == 1
    cruxes = claims.select("ord", "text")
    asked = ask(prompts.voices(spark.createDataFrame([("p", "Pro"), ("q", "Con")], "position_id string, label string"), cruxes))
    assert "Con\nPro" in asked and "5. text 4" in asked and "6. " not in asked


def test_replies(spark, rows, claims):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    said = spark.createDataFrame([("a", "b", '{"same": true}'), ("a", "c", "no"), ("a", "d", '{"same": false}')], "a string, b string, response string")
    assert rows(providers.confirmed_duplicates(pairs, said)) == [("a", "b")]
    reply = spark.createDataFrame([('[{"label": "x", "members": [1, 6, 99]}, {"label": "y", "members": []}]',)], "response string")
    # the sixth claim shown is the seventh asserted, as one no longer stands
    assert rows(providers.fallback_positions(claims, reply), "position_id", "label", "claim_id") == [("pos_01", "x", "clm_000"), ("pos_01", "x", "clm_006")]
    vectors = providers.embedded(claims.select(F.col("claim_id").alias("id"), "text").union(spark.createDataFrame([("n", None)], "a string, b string")), lambda: lambda texts: [[float(len(t))] for t in texts])
    assert vectors.count() == 61 and vectors.where("id = 'n'").first().vector == [0.0]
    asked = spark.createDataFrame([(k, "r", "x" * 40) for k in range(10)], "ord int, role string, prompt string")
    assert rows(providers.within_budget(asked, 25), "ord") == [(0,), (1,), (2,)]
    assert rows(providers.with_usage(asked.limit(1).withColumn("response", F.lit("abcde"))), "input_tokens", "output_tokens") == [(10, 2)]


def test_page_rows(spark, rows, claims):
    held = claims.select(F.lit("p").alias("position_id"), "claim_id", "ord")
    shown = R.members_shown(held)
    assert shown.where("open").count() == 15 and shown.count() == 60
    assert [r.source_title for r in R.source_names(claims).collect()] == ["A", "B"]
    assert rows(R.average_confidence(spark.createDataFrame([], "confidence double"))) == [(0, 0.0)]
    edges = spark.createDataFrame([("clm_001", "clm_000", "supports", "active"), (None, "clm_000", "supports", "active"), ("clm_002", "clm_000", "contradicts", "superseded")], "source string, target string, edge_type string, status string")
    assert rows(R.claim_links(claims, edges, held.where("ord = 0"))) == [("clm_000", "position", "p"), ("clm_000", "supports", "clm_001")]
    none = spark.createDataFrame([], "score double")
    assert R.is_settled(none, held) and not R.is_settled(spark.createDataFrame([(0.1,)], "score double"), held)
    assert rows(store.first_per_key(claims, "source_url", 3, "ord"), "source_url", "ord", "rank") == [("u0", 0, 1), ("u0", 2, 2), ("u0", 4, 3), ("u1", 1, 1), ("u1", 3, 2), ("u1", 5, 3)]

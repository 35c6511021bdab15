import json
import os

import pytest

from loomgraph import pipeline
from loomgraph.config import load_settings
from loomgraph.operators import trials
from loomgraph.sources import files

SMALL = "/root/testdata/sf0.001"


def test_settings_order_and_unknown_keys():
    s = load_settings({"crux": {"decay": 0.5, "top_n": 3}}, {"LOOMGRAPH_CRUX_DECAY": "0.9", "LOOMGRAPH_DISCOURSE_MIN_CLUSTER_SIZES": "3,4"})
    assert (s.crux.decay, s.crux.top_n, s.discourse.min_cluster_sizes) == (0.9, 3, (3, 4))
    for bad in ({"cruxx": {}}, {"crux": {"dekay": 1}}):
        with pytest.raises(KeyError):
            load_settings(bad, {})


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("line\nline")
    r = files.read_text_files(spark, str(tmp_path / "t")).first()
    assert (r.title, r.text, r.char_count) == ("one", "line\nline", 9)
    (tmp_path / "r.json").write_text(json.dumps({"case_name": "c", "sources": [{"url": "u1", "type": "pdf", "credibility_signals": {"citation_count": 4}}, {"url": "u2"}]}))
    reg = files.read_registry(spark, str(tmp_path / "r.json"))
    assert [(r.url, r.source_type) for r in files.first_sources(reg, 1).collect()] == [("u1", "pdf")]
    with pytest.raises(FileNotFoundError):
        files.read_registry(spark, str(tmp_path / "none.json"))
    assert files.read_vectors(spark, str(tmp_path / "v")) is None
    files.write_vectors(spark.createDataFrame([("a", [1.0])], "id string, vector array<float>"), str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == 1


def test_trials(spark, rows):
    claims = spark.createDataFrame([(f"c{k}", k, f"enormous glaciers {k}", "u") for k in range(30)], "claim_id string, ord int, text string, source_url string")
    assert trials.trial_prompts(claims).count() == 150
    replies = spark.createDataFrame([("a", "m-1", "VERIFIED")] * 4 + [("a", "n-1", "unverified"), ("b", "m-1", "95%")], "claim_id string, model string, response string")
    got = {r.claim_id: (r.successes, r.trials, r.label) for r in trials.trial_results(replies).collect()}
    assert got == {"a": (4, 5, "LOW"), "b": (1, 1, "UNKNOWN")}
    batches = trials.overlapping_batches(claims, 10, 2)
    assert rows(batches.where("batch = 1"), "place")[0] == (0,) and batches.groupBy("claim_id").count().where("count > 2").count() == 0
    assert batches.where("batch = 0").count() == 10
    dims = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 0.1, 1.0), ("b", 1.0, 1.0, 1.0, 0.9, 1.0)], "claim_id string, evidence_strength double, logical_consistency double, adversarial_robustness double, source_quality double, cross_model_agreement double")
    assert rows(trials.assessed_status(dims), "claim_id", "status") == [("a", "refuted"), ("b", "active")]
    texts = spark.createDataFrame([("u", "about glaciers only", False, "paper", True)], "source_url string, text string, peer_reviewed boolean, source_type string, known_reliable boolean")
    edges = spark.createDataFrame([("e", "c1", "c2", "contradicts", "active")], "edge_id string, source string, target string, edge_type string, status string")
    tiers = {r.claim_id: (r.tier, r.flags) for r in trials.four_tiers(claims, edges, texts, claims.where("ord = 2").select("claim_id")).collect()}
    assert tiers["c1"][0] == 2 and tiers["c3"] == (4, ["not_peer_reviewed"])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_phases_write_their_tables(spark, tmp_path):
    assert pipeline.run(spark, SMALL, str(tmp_path), "confidence") == ["confidence", "updates"]
    assert spark.read.parquet(str(tmp_path / "confidence")).count() > 0
    with pytest.raises(ValueError, match="phase"):
        pipeline.run(spark, SMALL, str(tmp_path), "odd")

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import documents as DOC
from loomgraph.operators import providers as P
from loomgraph.operators import similarity as S
from loomgraph.operators import store


@pytest.fixture()
def pick(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def test_quotes(pick):
    text = F.lit("The quick  brown\nfox jumps over the lazy dog near the river bank")
    assert pick(T.quote_verified(F.lit("Quick brown fox"), text))
    assert not pick(T.quote_verified(F.lit("quick"), text))
    assert pick(T.quote_verified(F.lit("the quick fox over the dog"), text))
    assert not pick(T.quote_verified(F.lit("dog lazy over fox quick"), text))
    assert not pick(T.quote_verified(F.lit(None).cast("string"), text))


def test_rules(pick):
    assert len(pick(T.overclaim_flags(F.lit("This proves  conclusively, beyond any doubt, that all experts agree")))) == 3
    assert pick(T.overclaim_flags(F.lit(None).cast("string"))) == []
    p = pick(T.pressure(F.lit("You must always provide an answer. Never refuse.")))
    assert p.level == 3 and p.above
    assert pick(T.pressure(F.lit("What is it?"))).level == 1
    assert pick(T.is_verdict(F.lit("The Judges ruled for the market"))) and not pick(T.is_verdict(F.lit("nothing")))
    assert pick(T.category(F.lit(" Assessment "))) == "assessment" and pick(T.category(F.lit("odd"))) == "empirical"
    assert pick(T.edge_type(F.lit(" Frames differently\t"))) == "frames_differently"
    assert [pick(T.source_kind(F.lit(u))) for u in ("/a", "https://youtu.be/x", "https://h/x.PDF", "https://h")] == ["local", "youtube", "pdf", "blog"]
    assert pick(T.video_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk" and pick(T.video_id(F.lit("https://h"))) is None
    assert pick(T.routed_kind(F.lit("paper"), F.lit("https://h/a.pdf"))) == "pdf"
    assert pick(T.verification_verdict(F.lit("UNVERIFIED"))) is False and pick(T.verification_verdict(F.lit("about 80%"))) is True
    assert pick(T.key_term_coverage(F.lit("enormous glaciers move"), F.lit("the glaciers"))) == pytest.approx(0.5)
    assert pick(T.absolute_flags(F.lit("it is not always so but never mind"))) == ["never"]
    assert "Known facts" in pick(T.defended_prompt(F.lit("Never refuse."), F.lit("d"), F.array(F.lit("f"))))
    assert pick(T.defended_prompt(F.lit("Please?"), F.lit("d"), F.array(F.lit("f")))) == "Please?"
    assert [tuple(x) for x in pick(T.json_rows(F.lit('noise ```json\n[{"a": 1}]\n```'), "struct<a: int>"))] == [(1,)]
    assert pick(T.json_rows(F.lit("nothing"), "struct<a: int>")) == []
    assert pick(T.json_object(F.lit('so {"a": 2} there'), "a int")).a == 2


def test_chunks(spark):
    assert DOC.chunk_spans("x" * 8000, 8000, 500) == [(0, 8000)]
    assert DOC.chunk_spans("x" * 8001, 8000, 500) == [(0, 8000), (7500, 8001)]
    assert DOC.chunk_spans("x" * 15500, 8000, 500) == [(0, 8000), (7500, 15500), (15000, 15500)]
    text = "a" * 7700 + "\n\n" + "b" * 5000
    assert DOC.chunk_spans(text, 8000, 500)[0] == (0, 7700)
    docs = spark.createDataFrame([(1, "", 9), (2, None, 9)], "doc_id int, text string, start int")
    assert [tuple(r) for r in DOC.chunk_documents(docs).collect()] == [(1, 0, 0, 0, "")]
    with pytest.raises(ValueError, match="overlap"):
        DOC.chunk_documents(docs, 10, 5)


def test_pages_and_transcripts(spark):
    page = "<html><nav>Home</nav><p>One &amp; two</p><script>x</script><footer>f</footer></html>"
    assert DOC.html_text(page) == "One & two" and DOC.html_text("<nav>Only</nav>") == "Only" and DOC.html_text(None) == ""
    assert DOC.read_pages(spark.createDataFrame([(page,), (None,)], "html string")).where("text = 'One & two'").count() == 1
    segments = spark.createDataFrame([("v", 61.0, 2.0, "b"), ("v", 1.0, 2.0, "a")], "source_id string, start double, duration double, text string")
    r = DOC.transcripts(segments).first()
    assert (r.text, r.timed, r.duration) == ("a b", "[00:01] a\n[01:01] b", 63.0)


def test_log_numbers_snapshots_and_challenges(spark, tmp_path, rows):
    drafts = spark.createDataFrame([(k, "claim.asserted", json.dumps({"claim_id": f"clm_{k}", "confidence": "0.4"})) for k in range(20)], "ord int, event_type string, payload string")
    log = store.append_events(drafts, str(tmp_path / "log"), 100)
    assert rows(log, "tx") == [(t,) for t in range(101, 121)]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20
    with pytest.raises(Exception, match="unknown event type"):
        store.number_events(drafts.withColumn("event_type", F.lit("odd"))).collect()
    said = [("evt_9", "position.stated", 119, '{"position_id": "pos_1", "member_claims": ["clm_1"]}'), ("evt_8", "meta.flag", 118, '{"flag_type": "note"}'), ("evt_7", "challenge.raised", 117, '{"challenge_id": "chl_9"}')]
    more = spark.createDataFrame(said, "event_id string, event_type string, tx bigint, payload string")
    mark = store.save_snapshot(log.unionByName(more, allowMissingColumns=True), str(tmp_path / "snap"))
    held = store.load_snapshot(spark, str(tmp_path / "snap"))
    assert mark == 120 and {k: df.count() for k, df in held.items()} == {"claims": 20, "edges": 0, "positions": 1, "challenges": 1, "flags": 1}
    assert held["claims"].where("up_to_tx = 120 and status = 'active'").count() == 20
    assert store.as_of(log, 110).count() == 10
    challenge = spark.createDataFrame([(1, "chl_1", "clm_3", "factual", "no", "u")], "ord int, challenge_id string, target string, challenge_type string, body string, source_url string")
    raised = store.number_events(store.challenge_events(challenge), 120)
    state = store.edge_state(log.select("event_type", "tx", "supersedes", "payload").unionByName(raised.select("event_type", "tx", F.lit(None).cast("string").alias("supersedes"), "payload")))
    assert rows(state, "source", "target", "edge_type") == [("clm_chl_1", "clm_3", "contradicts")]
    assert store.claim_state(log).where("confidence = 0.4").count() == 20
    (tmp_path / "log.json").write_text('{"event_id": "e1", "event_type": "meta.flag", "tx": 1, "payload": {"a": 1}}\n\nbroken\n')
    assert store.read_json_log(spark, str(tmp_path / "log.json")).count() == 1


def test_candidate_pairs_and_leaders(spark, rows):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[10] = 0
    data = [(f"c{k}", k, f"s{k % 3}", [float(v) for v in x[k]]) for k in range(60)]
    df = spark.createDataFrame(data, "id string, ord bigint, source_url string, vector array<double>")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    sims = unit @ unit.T
    want = {(f"c{i}", f"c{j}") for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= (0.3 if i % 3 != j % 3 else 0.5)}
    got = S.similar_pairs(df, within=0.5, cross=0.3, block=16)
    assert {(r.a, r.b) for r in got.collect()} == want
    ranked = S.candidate_pairs(df, within=0.5, cross=0.3, per_claim=2).orderBy("rank").collect()
    assert len(ranked) == min(120, len(want)) and [r.rank for r in ranked] == list(range(1, len(ranked) + 1))
    assert S.batches(spark.createDataFrame([(1,), (16,)], "rank int")).orderBy("rank").collect()[1].batch == 1
    pairs = {tuple(sorted(rng.choice(40, 2, replace=False))) for _ in range(60)}
    absorbed, leader = set(), {}
    for i in range(40):
        if i in absorbed:
            continue
        leader[i] = i
        for j in range(i + 1, 40):
            if (i, j) in pairs and j not in absorbed:
                absorbed.add(j)
                leader[j] = i
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a int, b int")
    nodes = spark.createDataFrame([(k, k) for k in range(40)], "id int, ord int")
    assert dict(rows(S.duplicate_leaders(frame, nodes), "id", "leader")) == leader
    chain = spark.createDataFrame([("A", "B"), ("B", "C")], "a string, b string")
    three = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "id string, ord int")
    assert dict(rows(S.duplicate_leaders(chain, three), "id", "leader")) == {"A": "A", "B": "A", "C": "C"}


def test_providers(spark, rows):
    prompts = spark.createDataFrame([("extract", "p1", 1), ("extract", "p2", 2)], "role string, prompt string, ord int")
    keyed = P.with_key(prompts)
    replies = keyed.where("prompt = 'p1'").select("prompt_sha256", F.lit("yes").alias("response"))
    assert rows(P.recorded(prompts, replies), "prompt", "response") == [("p1", "yes"), ("p2", None)]
    assert rows(P.live(prompts, lambda: lambda role, prompt: prompt.upper()), "response") == [("P1",), ("P2",)]
    assert P.within_budget(prompts, 1, per_char=1.0).count() == 1
    said = json.dumps([{"claim": "This proves conclusively it", "quote": "it was a long day", "category": "odd"}, {"claim": " ", "quote": "x"}])
    got = P.extracted_claims(spark.createDataFrame([("u", 0, said), ("w", 0, "bad")], "source_url string, chunk_index int, response string"), spark.createDataFrame([("u", "It was a long day.")], "source_url string, text string")).collect()
    assert [(r.claim_id, r.category, r.quote_verified, len(r.flags), r.confidence) for r in got] == [("clm_000001", "empirical", True, 1, 0.5)]
    flagged = P.entailment_flags(spark.createDataFrame([("a", '{"entailed": false, "verdict": "fabrication"}'), ("b", "??"), ("c", '{"entailed": true}')], "claim_id string, response string"))
    assert rows(flagged) == [("a", "fabrication", 0.1)]
    pairs = spark.createDataFrame([("a", "b", 0, 0), ("a", "c", 0, 1)], "a string, b string, batch int, place int")
    made = P.classified_edges(pairs, spark.createDataFrame([(0, '[{"type": "supports", "strength": 0.7}, {"type": "none"}, {"type": "refines"}]')], "batch int, response string"))
    assert rows(made, "edge_id", "edge_type", "source", "target") == [("edg_000001", "supports", "a", "b")]
    old = spark.createDataFrame([("e1", "contradicts", "a", "b", 0.5), ("e2", "contradicts", "a", "c", 0.5)], "edge_id string, edge_type string, source string, target string, strength double")
    new = P.reclassified(old, spark.createDataFrame([("e1", '{"confirmed": false, "type": "none"}'), ("e2", '{"confirmed": false, "type": "qualifies"}')], "edge_id string, response string"))
    assert rows(new, "edge_id", "edge_type", "status") == [("e1", "none", "superseded"), ("e2", "qualifies", "active")]
    claims = spark.createDataFrame([(k, k / 10) for k in range(10)], "ord int, confidence double")
    assert rows(P.mid_band(claims, 0.2), "ord") == [(4,), (5,)]
    positions = spark.createDataFrame([("p", "c2", 2), ("p", "c1", 1)], "position_id string, claim_id string, ord int")
    assert rows(P.labelled_positions(positions, spark.createDataFrame([("p", "?")], "position_id string, response string")), "label", "core_claim") == [("p", "c1")]
    assert P.missing_voices(spark.createDataFrame([('[{"perspective": "x"}, {"perspective": ""}]',)], "response string")).count() == 1


def test_quotes_are_checked_against_texts_of_their_source(spark, rows, tmp_path):
    from loomgraph.plans.graph import quote_fuzzy

    text = "the settlement was abandoned long before the flood reached it"
    quotes = [("c1", text[4:40], "u1", None), ("c2", "settlement abandoned long before flood reached", "u9", "A title "), ("c3", "words that no source text holds", "u1", "a title"), ("c4", text[4:40], "u9", None), ("c5", None, "u1", None)]
    base = spark.read.parquet("/root/testdata/sf0.001/extraction_results.parquet").schema
    data = [{f.name: None for f in base} | {"claim_id": c, "natural_language": "other", "relevant_quote": q, "source_url": u, "source_title": t} for c, q, u, t in quotes]
    spark.createDataFrame([tuple(d.values()) for d in data], base).write.parquet(f"{tmp_path}/extraction_results.parquet")
    spark.createDataFrame([("u1", "x", text), ("u1", None, None)], "url string, title string, text string").write.parquet(f"{tmp_path}/fetch_results.parquet")
    spark.createDataFrame([("a title", text)], "title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(quote_fuzzy(spark, str(tmp_path))) == [("c1", True), ("c2", True), ("c3", False), ("c4", False)]


def test_quotes_among_many_texts_equal_a_comparison_of_all(spark, rows, monkeypatch):
    import random

    from loomgraph.operators import documents as DOC

    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["The", "a"]
    texts = [(f"k{k % 3}", " ".join(rng.choice(words) for _ in range(60)) if k % 19 else None) for k in range(60)]
    quotes = []
    for k in range(150):
        kept = (texts[rng.randrange(60)][1] or "").split(" ")
        at = rng.randrange(40)
        part = [w if rng.random() > (k % 4) / 8 else "other" for w in kept[at : at + rng.randrange(1, 16)]]
        text = " ".join(part)
        quotes.append((k, f"k{k % 4}", (text[1:-1] if k % 5 == 0 else text) + ("" if k % 7 else "  ")))
    quotes += [(1000, "k0", " " * 12), (1001, "k0", None), (1002, None, "w1 w2 w3 w4")]
    q = spark.createDataFrame(quotes, "id int, key string, quote string")
    t = spark.createDataFrame(texts, "key string, text string")
    want = rows(q.join(t, "key").where(T.quote_verified(F.col("quote"), F.col("text"))).select("id").distinct())
    assert 20 < len(want) < 150
    for most in ((20_000, 1_000, 4_000_000), (9, 4, 4_000_000), (50, 100, 500)):
        for name, value in zip(("QUOTES", "TEXTS", "CHARACTERS"), most, strict=True):
            monkeypatch.setattr(DOC, name, value)
        assert rows(DOC.verified_quotes(q, t)) == want


def test_state_keeps_a_confidence_that_later_patches_lack(spark, rows):
    from datetime import datetime

    day = lambda n: datetime(2024, 1, n)
    events = [
        ("claim.asserted", 1, None, '{"claim_id": "clm_1", "confidence": 0.4, "statement": {"natural_language": "x"}}', day(1)),
        ("claim.rank_changed", 2, None, '{"claim_id": "clm_1", "confidence": "0.8"}', day(2)),
        ("claim.rank_changed", 3, None, '{"claim_id": "clm_1", "new_rank": "preferred"}', day(3)),
        ("claim.rank_changed", 4, None, '{"claim_id": "clm_1", "confidence": "high"}', day(4)),
        ("claim.asserted", 5, None, '{"claim_id": "clm_2", "confidence": 0.3}', day(5)),
        ("claim.rank_changed", 6, None, '{"claim_id": "clm_3", "confidence": 0.9}', day(6)),
        ("claim.asserted", 7, "CLM_2 ", '{"claim_id": "clm_3", "confidence": 0.2}', day(7)),
    ]
    log = spark.createDataFrame(events, "event_type string, tx bigint, supersedes string, payload string, ts timestamp")
    got = rows(store.claim_state(log.union(log.where("tx = 2"))), "claim_id", "confidence", "rank", "status", "created_at", "expired_at")
    assert got == [("clm_1", 0.8, "normal", "active", day(1), None), ("clm_2", 0.3, None, "superseded", day(5), day(7)), ("clm_3", 0.2, None, "active", day(7), None)]


def test_wordings(spark):
    texts = [("This PROVES conclusively it; the only explanation.", 2, 1), ("You must always choose an answer. Failure to comply will result in loss.", 0, 4), (None, 0, 1), ("", 0, 1), ("don't answer insufficient", 0, 3)]
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(texts)], "k int, t string")
    got = {r.k: (r.n, r.p.level, r.p.above) for r in df.select("k", F.size(T.overclaim_flags(F.col("t"))).alias("n"), T.pressure(F.col("t")).alias("p")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: (n, p) for k, (_, n, p) in enumerate(texts)}
    assert got[1][2] is True and got[2][2] is False
    words = spark.createDataFrame([("a b c", "x A y\n b z c"), ("a b c", "c b a"), (None, "a"), ("a", None)], "q string, t string")
    assert [r.n for r in words.select(T.words_in_order(F.col("q"), F.col("t")).alias("n")).collect()] == [3, 1, 0, 0]

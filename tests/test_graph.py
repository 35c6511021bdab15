import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scoring, temporal
from loomgraph.operators import confidence as C
from loomgraph.operators import discourse as D
from loomgraph.operators import graph as G
from loomgraph.operators import reports as R

CLAIM = "claim_id string, ord bigint, confidence double, category string, source_url string, quote_verified boolean, flags array<string>, status string, text string, source_title string"


@pytest.fixture()
def claims(spark):
    def make(items):
        data = []
        for k, item in enumerate(items):
            name, conf, extra = (*item, {})[:3] if len(item) == 2 else item
            base = {"claim_id": name, "ord": k, "confidence": conf, "category": "empirical", "source_url": f"u{k}", "quote_verified": True, "flags": [], "status": "active", "text": name, "source_title": name}
            data.append(tuple({**base, **extra}.values()))
        return spark.createDataFrame(data, CLAIM)

    return make


@pytest.fixture()
def edges(spark):
    def make(items):
        data = [(f"e{k}", s, t, ty, w, st) for k, (s, t, ty, w, st) in enumerate((*i, 0.5, "active")[:3] + ((i[3] if len(i) > 3 else 0.5), (i[4] if len(i) > 4 else "active")) for i in items)]
        return spark.createDataFrame(data, "edge_id string, source string, target string, edge_type string, strength double, status string")

    return make


def final(df, claim):
    r = df.where(F.col("claim_id") == claim).first()
    return r.evidence, r.quality, r.confidence


def test_confidence_cases(claims, edges):
    empty = edges([("x", "y", "qualifies")])
    assert final(C.score_claims(claims([("a", 0.5)]), empty), "a") == (0.5, 0.45, 0.225)
    two = claims([("a", 0.5), ("b", 0.5)])
    assert final(C.score_claims(two, edges([("b", "a", "supports", 0.8)])), "a") == (0.8, 0.45, 0.36)
    assessed = claims([("a", 0.5), ("b", 0.5, {"category": "assessment"})])
    assert final(C.score_claims(assessed, edges([("b", "a", "supports", 0.8)])), "a") == (0.24, 0.45, 0.108)
    against = claims([("a", 0.5), ("b", 0.8)])
    assert final(C.score_claims(against, edges([("b", "a", "contradicts")])), "a") == (0.5, 0.15, 0.075)
    three = [("a", 0.5), ("b", 0.5), ("c", 0.5)]
    lines = edges([("b", "a", "supports", 0.6), ("c", "a", "supports", 0.6)])
    assert final(C.score_claims(claims(three), lines), "a")[0] == 0.84
    same = [("a", 0.5), ("b", 0.5, {"source_url": "u"}), ("c", 0.5, {"source_url": "u"})]
    assert final(C.score_claims(claims(same), lines), "a")[0] == 0.6
    inactive = [("a", 0.5), ("b", 0.5, {"status": "superseded"}), ("c", 0.5)]
    assert final(C.score_claims(claims(inactive), lines), "a")[0] == 0.6


def test_what_was_superseded_or_patched_changes_the_core_queries(spark, rows, tmp_path):
    import json

    from loomgraph.plans import graph as plans

    def folder(name, events):
        path = tmp_path / name
        base = spark.read.parquet("/root/testdata/sf0.001/extraction_results.parquet").schema
        data = [{f.name: None for f in base} | {"claim_id": f"CLM_{k} ", "natural_language": "so judges ruled" if k == 0 else "x", "source_url": f"u{k}", "confidence": 0.4, "quote_verified": True} for k in range(4)]
        spark.createDataFrame([tuple(d.values()) for d in data], base).write.parquet(f"{path}/extraction_results.parquet")
        edge = spark.read.parquet("/root/testdata/sf0.001/trace_edges.parquet").schema
        links = [("e1", "clm_1", "clm_0", "supports"), ("e2", "clm_2", "clm_0", "supports"), ("e3", "clm_3", "clm_0", "contradicts"), ("e4", "clm_2", "clm_0", "is_crux_for")]
        rows_of = [{f.name: None for f in edge} | {"edge_id": e, "source": s, "target": t, "edge_type": k, "strength": 0.6} for e, s, t, k in links]
        spark.createDataFrame([tuple(d.values()) for d in rows_of], edge).write.parquet(f"{path}/trace_edges.parquet")
        made = [("claim.asserted", 1 + k, None, json.dumps({"claim_id": f"clm_{k}"})) for k in range(4)] + [("edge.asserted", 5 + k, None, json.dumps({"edge_id": f"e{k + 1}"})) for k in range(4)]
        log = [(f"evt_{tx}", kind, tx, ref, body, None) for kind, tx, ref, body in made + events]
        spark.createDataFrame(log, "event_id string, event_type string, tx bigint, supersedes string, payload string, ts timestamp").write.parquet(f"{path}/event_log.parquet")
        return str(path)

    plain = folder("plain", [])
    moved = folder("moved", [
        ("claim.superseded", 20, None, '{"old_claim_id": "clm_2"}'), ("claim.rank_changed", 21, None, '{"claim_id": "clm_3", "confidence": 0.8}'),
        ("claim.rank_changed", 22, None, '{"claim_id": "clm_3"}'), ("claim.rank_changed", 23, None, '{"claim_id": "clm_1", "confidence": 0.95}'),
    ])
    none = folder("none", [("heartbeat", 20, " E1", None)])
    before = {r.claim_id: r for r in plans.claim_confidence(spark, plain).collect()}
    after = {r.claim_id: r for r in plans.claim_confidence(spark, moved).collect()}
    assert (before["clm_0"].evidence, before["clm_0"].clusters, before["clm_0"].weakest) == (0.84, 2, "source")
    assert (after["clm_0"].evidence, after["clm_0"].clusters, after["clm_0"].weakest) == (0.6, 1, "consistency") and "clm_2" not in after
    assert {r.claim_id: r for r in plans.claim_confidence(spark, none).collect()}["clm_0"].clusters == 1
    assert rows(plans.contradicted_claims(spark, plain)) == [] and rows(plans.contradicted_claims(spark, moved)) == [("clm_0",)]
    # a firm dependency is not contested, a patched one no longer
    assert [(r.n_contested, r.n_cruxes) for r in plans.settling(spark, plain).collect()] == [(2, 1)]
    assert [(r.n_contested, r.n_cruxes) for r in plans.settling(spark, moved).collect()] == [(1, 1)]
    assert rows(plans.unsupported_claims(spark, moved)) == [("clm_1",), ("clm_3",)]
    assert {r.claim_id: r.score > 0 for r in plans.crux_scores(spark, plain).collect()} == {"clm_0": False, "clm_1": True, "clm_2": True, "clm_3": False}


def crux_graph(claims, edges):
    nodes = claims([("target", 0.8), ("foundation", 0.5), ("mid", 0.7), ("irrelevant", 0.5), ("dead_end", 0.5), ("certain", 0.95), ("framework", 0.5)])
    links = edges([("foundation", "mid", "supports"), ("mid", "target", "supports"), ("irrelevant", "dead_end", "supports"), ("certain", "target", "supports"), ("framework", "target", "frames_differently")])
    return nodes, links


def test_crux_values(spark, claims, edges):
    nodes, links = crux_graph(claims, edges)
    score = {r.claim_id: r.score for r in G.crux_scores(nodes, links, spark.createDataFrame([("target",)], "claim_id string")).collect()}
    assert score["foundation"] == pytest.approx(0.945, abs=1e-5)
    assert score["mid"] == pytest.approx(0.30845, abs=1e-5)
    assert score["certain"] == pytest.approx(0.10024, abs=1e-5)
    assert score["irrelevant"] == score["dead_end"] == score["framework"] == score["target"] == 0
    both = {r.claim_id: r.score for r in G.crux_scores(nodes, links, spark.createDataFrame([("target",), ("dead_end",)], "claim_id string")).collect()}
    assert both["irrelevant"] == pytest.approx(0.35) and both["foundation"] == pytest.approx(0.4725)
    top = G.top_cruxes(G.crux_scores(nodes, links, spark.createDataFrame([("target",)], "claim_id string")), nodes, 2)
    assert {r.claim_id for r in top.collect()} == {"foundation", "mid"}


def test_parallel_edges_count_in_degree_but_are_walked_once(spark, claims, edges):
    nodes = claims([("a", 0.5), ("t", 0.9)])
    links = edges([("a", "t", "supports"), ("a", "t", "depends_on")])
    got = G.crux_scores(nodes, links, spark.createDataFrame([("t",)], "claim_id string")).where("claim_id = 'a'").first()
    assert got.score == pytest.approx(0.35)


def test_cruxes_equal_a_walk_from_each_claim(spark, claims, edges, monkeypatch):
    import random

    rng = random.Random(5)
    names = [f"c{k:03d}" for k in range(220)]
    kinds = ("supports", "depends_on", "is_crux_for")
    links = list({(rng.choice(names), rng.choice(names), rng.choice(kinds[:2])) for _ in range(420)} | {(a, b, "supports") for a, b in zip(names, names[1:30], strict=False)})
    links += [(names[3], "goal", "is_crux_for"), (names[29], "goal", "depends_on"), ("c001", "c001", "supports")]
    onto, degree = {}, {}
    for a, b, _ in links:
        onto.setdefault(a, set()).add(b)
        degree[b] = degree.get(b, 0) + 1
    useful = {"goal"}
    while more := {a for a, b, _ in links if b in useful} - useful:
        useful |= more
    want = {}
    for root in names:
        seen, front, gain = {root}, {root}, 0.0
        for depth in range(1, 21):
            front = {b for a in front for b in onto.get(a, ()) if b in useful} - seen
            seen |= front
            gain += sum(0.7**depth / degree[b] for b in front)
        want[root] = round(gain, 6)
    goal = spark.createDataFrame([("goal",)], "claim_id string")
    nodes = claims([(n, 0.5) for n in [*names, "goal"]])
    # neither pairs nor rounds of joins over all roots
    monkeypatch.setattr(G, "reach", None)
    for words in (32, 1):
        monkeypatch.setattr(G, "WALK_WORDS", words)
        got = {r.claim_id: r.score for r in G.crux_scores(nodes, edges(links), goal).collect()}
        assert max(abs(got[n] - want[n]) for n in names) < 2e-6 and got["goal"] == 0


def test_top_cruxes_fold_the_log_once(spark, monkeypatch):
    from loomgraph.plans import graph as plans
    from loomgraph.sources import claims as source

    folds, fold = [], source.state_view
    monkeypatch.setattr(source, "state_view", lambda *a: folds.append(a) or fold(*a))
    assert plans.top_cruxes(spark, "/root/testdata/sf0.001").columns == ["claim_id", "score"]
    assert len(folds) == 1


def test_reach_ends_on_cycles(spark, edges, rows):
    links = edges([("a", "b", "supports"), ("b", "c", "supports"), ("c", "a", "supports")])
    starts = spark.createDataFrame([("a",)], "root string")
    assert rows(G.reach(links, starts, 20), "node", "depth") == [("b", 1), ("c", 2)]
    assert rows(G.on_dependency_cycle(edges([("a", "b", "depends_on"), ("b", "a", "depends_on"), ("c", "a", "depends_on")]))) == [("a",), ("b",)]


def test_dependency_cycles_of_any_length(spark, edges, rows):
    ring = [(f"r{k:02d}", f"r{(k + 1) % 25:02d}", "depends_on") for k in range(25)]
    links = edges([*ring, ("r03", "out", "depends_on"), ("in", "r04", "depends_on"), ("own", "own", "depends_on")])
    assert rows(G.on_dependency_cycle(links)) == [("own",), *((f"r{k:02d}",) for k in range(25))]


def test_settling_values(spark, claims, edges):
    nodes = claims([("verdict", 0.9), ("market", 0.7), ("contested", 0.5), ("framework_dep", 0.6), ("other_frame", 0.5)])
    links = edges([("market", "verdict", "supports"), ("contested", "market", "supports"), ("framework_dep", "market", "supports"), ("contested", "verdict", "is_crux_for"), ("framework_dep", "other_frame", "frames_differently")])
    r = G.settling(nodes, links, spark.createDataFrame([("verdict",)], "claim_id string")).first()
    assert (r.n_dependencies, r.n_contested, r.n_cruxes, r.n_framework, r.severity, r.detected) == (3, 3, 1, 1, 1.0, True)
    firm = claims([("verdict", 0.9), ("support", 0.9)])
    r = G.settling(firm, edges([("support", "verdict", "supports")]), spark.createDataFrame([("verdict",)], "claim_id string")).first()
    assert not r.detected and r.severity == 0


def test_settling_follows_chains_of_any_length(spark, claims, edges):
    names = [f"c{k}" for k in range(30)]
    nodes = claims([(n, 0.9) for n in names[:-1]] + [("c29", 0.5)])
    links = edges([(b, a, "supports") for a, b in zip(names, names[1:], strict=False)] + [("c29", "c27", "supports"), ("c0", "c28", "depends_on")])
    r = G.settling(nodes, links, spark.createDataFrame([("c0",)], "claim_id string")).first()
    assert (r.n_dependencies, r.n_contested, r.detected) == (29, 1, True)


def test_verdict_edges_turn(spark, edges, rows):
    links = edges([("v", "a", "supports"), ("b", "c", "supports")])
    got = G.turned_edges(links, spark.createDataFrame([("v",), ("c",)], "claim_id string"))
    assert rows(got, "source", "target") == [("a", "v"), ("b", "c")]


def test_positions(spark, edges, rows):
    members = [("p", f"z{k}", k) for k in range(3)] + [("q", f"l{k}", k) for k in range(3)] + [("r", "m0", 9)]
    positions = spark.createDataFrame(members, "position_id string, claim_id string, ord int")
    links = edges([("z0", "l0", "contradicts"), ("z1", "l1", "contradicts"), ("l2", "z2", "frames_differently"), ("m0", "z0", "supports"), ("z1", "m0", "supports"), ("z0", "o1", "contradicts"), ("o2", "o1", "supports"), ("o3", "z1", "qualifies")])
    got = {(r.a, r.b): (r.contradicts, r.frames, r.kind) for r in D.disagreements(positions, links).collect()}
    assert got == {("p", "q"): (2, 1, "factual"), ("p", "r"): (0, 0, "unknown"), ("q", "r"): (0, 0, "unknown")}
    merged = {r.claim_id: r.position_id for r in D.merge_positions(positions, links).collect()}
    assert merged["m0"] == "p" and merged["l0"] == "q"
    assert rows(D.opposing_position(positions, links)) == [("o1",), ("o2",), ("o3",)]
    two = positions.where("position_id <> 'q'")
    assert D.merge_positions(two, links).select("position_id").distinct().count() == 2


def test_density_finds_blobs_and_rejects_noise(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(0, 0.05, (30, 4)), rng.normal(3, 0.05, (30, 4))])
    rows = [("case", f"c{k}", k, [float(x) for x in v]) for k, v in enumerate(blobs)]
    df = spark.createDataFrame(rows, "case_name string, id string, ord int, vector array<double>")
    got = D.density_positions(df).toPandas()
    assert got["label"].nunique() == 2 and len(got) >= 55
    sides = got.assign(side=got["id"].str[1:].astype(int) < 30).groupby("label")["side"].nunique()
    assert (sides == 1).all()
    assert D.density_positions(df.limit(4)).count() == 0


def test_density_holds_no_matrix_and_follows_deep_trees():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    # pairs of points that join one after another: a tree as deep as there are pairs
    line = np.cumsum(1.0 + np.arange(1500) * 1e-3)
    x = np.zeros((3000, 8))
    x[:, 0] = np.repeat(line, 2) + np.tile([0.0, 0.1], 1500)
    x[:, 1:] = rng.normal(0, 1e-4, (3000, 7))
    tracemalloc.start()
    labels = D._density_labels(x, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (labels >= 0).all() and (labels[::2] == labels[1::2]).all()
    assert peak < 64e6  # a matrix of all distances has 72 MB


def test_density_trees_of_all_sizes_come_from_two_passes(monkeypatch):
    import numpy as np

    from loomgraph.operators import density

    def dense_tree(x, least):
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        core = np.sort(gap, axis=1)[:, least - 1]
        reach = np.maximum(gap, np.maximum(core[:, None], core[None]))
        near, out, total = reach[0].copy(), np.zeros(len(x), dtype=bool), []
        out[0] = True
        for _ in range(len(x) - 1):
            at = int(np.argmin(np.where(out, np.inf, near)))
            total.append(near[at])
            out[at] = True
            near = np.minimum(near, reach[at])
        return np.sort(total)

    monkeypatch.setattr(density, "TILE", 64)
    monkeypatch.setattr(density, "HELD", 1 << 12)
    rng, made = np.random.default_rng(2), []
    plain = density._Tiles.between
    monkeypatch.setattr(density._Tiles, "between", lambda self, a, b: made.append((d := plain(self, a, b)).size) or d)
    spread = np.concatenate([rng.normal(size=(1, 16)) * 4 + rng.normal(size=(m, 16)) * s for m, s in ((500, 0.1), (400, 1), (150, 3))])
    apart = np.concatenate([rng.normal(size=(1, 16)) * 400 + rng.normal(size=(260, 16)) for _ in range(4)])
    tight = np.concatenate([rng.normal(size=(1, 16)) * 3 + rng.normal(size=(500, 16)) * 1e-4 for _ in range(2)])
    equal = np.repeat(rng.normal(size=(20, 16)), 50, axis=0)[rng.permutation(1000)]
    uneven = np.concatenate([rng.normal(size=(990, 16)), rng.normal(size=(10, 16)) * 1e6])
    for x in (spread, apart, tight, equal, uneven, rng.integers(0, 9, (1000, 3)).astype(float)):
        made.clear()
        near = density.Neighbourhood(x, 20)
        assert sum(made) < 1.3 * len(x) ** 2  # half the pairs twice, and the tiles on the diagonal
        assert len(near.pairs[0]) < 40 * len(x)
        for least in (5, 10, 15, 20):
            links = near.spanning_links(least)
            assert {p for _, *ends in links for p in ends} == set(range(len(x)))
            assert np.sort([w for w, _, _ in links]) == pytest.approx(dense_tree(x, least), rel=1e-9, abs=1e-9)


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    w = pick(scoring.wilson(F.lit(4), F.lit(5)))
    assert (round(w.lower, 3), round(w.upper, 3)) == (0.376, 0.964)
    assert tuple(pick(scoring.wilson(F.lit(0), F.lit(0)))) == (0.0, 1.0)
    assert pick(scoring.wilson(F.lit(0), F.lit(5))).lower == 0 and pick(scoring.wilson(F.lit(5), F.lit(5))).upper == 1
    assert pick(scoring.agreement(F.lit(2), F.lit(2), F.lit(1))) == pytest.approx(0.7)
    assert pick(scoring.source_quality(F.lit(True), F.lit(150), F.lit(25))) == pytest.approx(1.0)
    assert pick(scoring.source_quality(F.lit(True), F.lit(150), F.lit(25), F.lit(True))) == 0
    assert pick(scoring.binary_entropy(F.lit(0.5))) == 1 and pick(scoring.binary_entropy(F.lit(1.0))) == 0
    assert [pick(scoring.confidence_level(F.lit(v))) for v in (0.9, 0.75, 0.5, 0.25, 0.2)] == ["very_high", "high", "medium", "low", "very_low"]
    day = lambda s: F.lit(s).cast("date")
    null = F.lit(None)
    assert pick(temporal.valid_at(F.lit("active"), day("2020-01-01"), day("2020-12-31"), null, day("2020-12-31")))
    assert not pick(temporal.valid_at(F.lit("active"), day("2020-01-01"), null, null, day("2019-12-31")))
    assert not pick(temporal.valid_at(F.lit("superseded"), null.cast("date"), null, null, day("2020-01-01")))
    gate = pick(temporal.may_replace(F.lit(0.8), F.lit(0.6), F.lit(365)))
    assert gate.allowed and gate.bar == pytest.approx(0.56)
    assert pick(temporal.may_replace(F.lit(None).cast("double"), F.lit(0.1), F.lit(1))).allowed


def test_reports(claims, edges, rows, spark):
    nodes = claims([("a", 0.5), ("b", 0.5, {"status": "superseded"})])
    links = edges([("b", "a", "supports"), ("a", "b", "contradicts")])
    counts = {(r.section, r.name): r.n for r in R.graph_counts(nodes, links).collect()}
    assert counts[("total", "claims")] == 1 and counts[("edge_type", "supports")] == 1
    assert rows(G.unsupported_claims(nodes, links)) == []
    assert rows(G.open_contradictions(nodes, links)) == []
    usage = spark.createDataFrame([("m", 1, 2), ("n", 3, 4)], "model string, input_tokens int, output_tokens int")
    assert R.usage_rollup(usage).where("model is null").first().input_tokens == 4

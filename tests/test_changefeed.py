import json
import random

from loomgraph.operators import changefeed
from loomgraph.operators.changefeed import active_entities, apply_changes, event_effects, rebuild_state
from loomgraph.sources.publish import publish, read_current
from loomgraph.streaming.fold import compact, folded_state, merge_batch

SCHEMA = "event_id string, event_type string, tx bigint, supersedes string, payload string"


def replay(events):
    """Sequential application by rising tx, straight from the rules."""
    state = {}
    for tx, kind, ref, body in sorted({(e[2], (e[1] or "").strip().lower(), (e[3] or "").strip().lower(), e[4]) for e in events}, key=lambda e: e[0]):
        if ref in state:
            state[ref][1] = False
        fields = json.loads(body) if body else {}
        name = lambda k: (fields.get(k) or "").strip().lower()  # noqa: E731, B023
        if kind in ("claim.asserted", "edge.asserted"):
            key = name("claim_id" if kind[0] == "c" else "edge_id")
            if key:
                state[key] = [kind[0], True, tx, 0]
        elif kind == "claim.superseded" and state.get(name("old_claim_id"), "x")[0] == "c":
            state[name("old_claim_id")][1] = False
        elif kind == "claim.rank_changed" and state.get(name("claim_id"), "x")[0] == "c":
            state[name("claim_id")][3] = tx
    return sorted((k, v[2], v[3]) for k, v in state.items() if v[1])


def random_events(seed, n=400):
    rng = random.Random(seed)
    claims, edges = [f"clm_{k}" for k in range(8)], [f"edg_{k}" for k in range(5)]
    out = []
    for tx in range(1, n):
        kind = rng.choice(["claim.asserted", "edge.asserted", "claim.rank_changed", "claim.superseded", "heartbeat", "Claim.Asserted ", "CLAIM.RANK_CHANGED"])
        low = kind.strip().lower()
        claim = rng.choice(claims)
        key = {"edge.asserted": ("edge_id", rng.choice(edges)), "claim.superseded": ("old_claim_id", claim)}.get(low, ("claim_id", claim))
        body = None if rng.random() < 0.03 else json.dumps({key[0]: rng.choice([key[1], key[1].upper(), f" {key[1]}"]), "confidence": "high"})
        ref = rng.choice([None, "", "evt_3", "nothing", claim.upper(), rng.choice(edges)]) if rng.random() < 0.3 else None
        out.append((f"evt_{tx}", kind, tx, ref, body))
    out += rng.sample(out, 60)
    rng.shuffle(out)
    return out


def test_state_equals_sequential_replay(spark, rows):
    for seed in (1, 2):
        events = random_events(seed)
        got = active_entities(rebuild_state(spark.createDataFrame(events, SCHEMA)))
        assert rows(got) == replay(events)


def test_deletes_before_inserts_leave_tombstones(spark):
    events = [("e2", "claim.superseded", 2, None, '{"old_claim_id": "clm_1"}'), ("e1", "claim.asserted", 1, None, '{"claim_id": "clm_1"}'), ("e3", "x", 3, "clm_9", None)]
    state = {r.entity_id: r for r in apply_changes(event_effects(spark.createDataFrame(events, SCHEMA))).collect()}
    assert not state["clm_1"].active and state["clm_1"].insert_seq == 3
    assert state["clm_9"].insert_seq == -1 and not state["clm_9"].active and state["clm_9"].entity_kind is None


def test_patch_and_supersession_apply_to_claims_only(spark, rows):
    events = [
        ("e1", "edge.asserted", 1, None, '{"edge_id": "edg_1"}'),
        ("e2", "claim.rank_changed", 2, None, '{"claim_id": "edg_1"}'),
        ("e3", "claim.superseded", 3, None, '{"old_claim_id": "edg_1"}'),
    ]
    assert rows(active_entities(apply_changes(event_effects(spark.createDataFrame(events, SCHEMA))))) == [("edg_1", 1, 0)]


def test_nulls_bad_json_empty_and_extra_columns(spark, rows):
    events = [(None, None, None, None, None, 1), ("e", "claim.asserted", None, None, "{}", 2), ("e", "claim.asserted", 5, None, "not json", 3), ("e", "claim.asserted", 6, "clm_1", '{"claim_id": "clm_1"}', 4)]
    df = spark.createDataFrame(events, SCHEMA + ", entity_id int")
    assert rows(active_entities(apply_changes(event_effects(df)))) == [("clm_1", 6, 0)]
    assert rows(active_entities(apply_changes(event_effects(df.limit(0))))) == []


def test_publication_switches_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(3), path)
    assert read_current(spark, path).count() == 3
    publish(spark.range(5), path)
    assert read_current(spark, path).count() == 5


def test_streamed_batches_in_any_order_give_the_batch_state(spark, rows, tmp_path):
    events = random_events(7, 120)
    df = spark.createDataFrame(events, SCHEMA)
    path = str(tmp_path / "fold")
    for part in (df.where("tx > 60"), df.where("tx <= 60"), df.where("tx between 50 and 70")):
        merge_batch(part, path)
    assert rows(active_entities(folded_state(spark, path))) == replay(events)
    compact(spark, path)
    assert rows(active_entities(folded_state(spark, path))) == replay(events)


def test_a_replayed_batch_replaces_itself(spark, rows, tmp_path):
    df = spark.createDataFrame(random_events(9, 80), SCHEMA)
    path = str(tmp_path / "fold")
    for number in (0, 1, 1):
        merge_batch(df.where(f"tx % 2 = {number}"), path, number)
    assert rows(active_entities(folded_state(spark, path))) == replay(random_events(9, 80))


def delivered(events):
    """One bucket's changes, delivery by delivery, in the order given."""
    import pyarrow as pa

    rows = []
    for name, seq, effect, kind, body in events:
        rows.append({"entity_id": name, "effect": effect, "seq": seq, "entity_kind": kind, "body": body, "moment": seq % 5})
    return pa.RecordBatch.from_pylist(rows, changefeed._CHANGE_FIELDS)


def bucket(events, statement, newer=None):
    """States of a bucket that takes ``statement`` deliveries at a time."""
    kept = changefeed._Upserts.STATEMENT, changefeed._Upserts.NEWER
    changefeed._Upserts.STATEMENT = statement
    changefeed._Upserts.NEWER = newer or kept[1]
    try:
        (out,) = changefeed._apply_bucket(iter([delivered(events)]))
        return sorted(map(str, out.to_pylist()))
    finally:
        changefeed._Upserts.STATEMENT, changefeed._Upserts.NEWER = kept


def test_the_conflict_clause_decides_between_deliveries():
    rng = random.Random(3)
    events = []
    for seq in range(1, 300):
        effect = rng.choice(["insert", "insert", "patch", "delete"])
        kind = {"insert": "claim", "patch": "claim"}.get(effect, rng.choice([None, "claim"]))
        events.append((f"clm_{rng.randrange(12)}", seq, effect, kind, rng.choice([None, f"b{seq}"]) if effect != "delete" else None))
    events += [(n, s, e, k, "again" if e == "insert" else b) for n, s, e, k, b in rng.sample(events, 40)]
    expected = bucket(events, 10_000)
    for seed in range(3):
        random.Random(seed).shuffle(events)
        assert bucket(events, 1) == expected
        assert bucket(events, 7) == expected
        # without the comparison of stored sequences the last delivery wins
        assert bucket(events, 7, "({new}) is not distinct from ({new}) or ({old}) = ({new})") != expected


def test_a_map_task_that_empties_its_table_loses_nothing(spark, rows, monkeypatch):
    events = random_events(5)
    batches = [delivered([(r.entity_id, r.seq, r.effect, r.entity_kind, r.body)]) for r in event_effects(spark.createDataFrame(events, SCHEMA), True).collect()]
    monkeypatch.setattr(changefeed, "FLUSH", 200)
    partial = list(changefeed._apply_locally(iter(batches)))
    assert sum(b.num_rows for b in partial) > 60
    (state,) = changefeed._apply_bucket(iter(partial))
    active = sorted((r["entity_id"], (r["insert_seq"] - 1) // 2, ((r["patch_seq"] or 1) - 1) // 2) for r in state.to_pylist() if r["active"])
    assert active == replay(events)

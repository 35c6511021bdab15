import random
import re
from itertools import combinations

from loomgraph.llm import clusters, components, near_duplicates
from loomgraph.llm.components import consolidate, restatement_pairs


def union_find(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(top)}


def test_groups_equal_union_find(spark, rows):
    rng = random.Random(1)
    names = [f"v{k:03d}" for k in range(150)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(80)]
    pairs += [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(50)] + [("hub", f"s{k}") for k in range(60)]
    pairs += pairs[:9] + [("x", "x"), (None, "v001"), ("v002", None)]
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("*", "1 as v", "2 as label")
    assert dict(rows(consolidate(df), "member", "group")) == union_find(pairs)
    assert consolidate(df.limit(0)).count() == 0


def test_restatements_read_untidy_edges(spark, rows):
    data = [(" Refines\t", "CLM_1", "clm_2 "), ("supports", "clm_1", "clm_3"), ("supersedes", "evt_1", "clm_4"), (None, "clm_5", "clm_6"), ("refines", None, "clm_6")]
    df = spark.createDataFrame(data, "edge_type string, source string, target string")
    assert rows(restatement_pairs(df)) == [("clm_1", "clm_2")]


def words(*fields):
    return frozenset(re.findall("[a-z0-9]+", " ".join(f for f in fields if f).lower()))


def edited_texts(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(n):
        if texts and rng.random() < 0.5:
            base = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rng.shuffle(base)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))))
    return [(f"c{k:03d}", t, rng.choice([None, "", t[:20]])) for k, t in enumerate(texts)]


def brute_pairs(records, threshold):
    sets = {i: words(a, b) for i, a, b in records}
    return sorted(
        (a, b) for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    )


def test_near_duplicates_equal_brute_force(spark, rows):
    records = edited_texts(3) + [("z1", None, None), ("z2", "", "!!"), ("z3", "Only ONE", None), ("z4", "one only", ""), ("y1", "long " * 5000 + "tail", None), ("y2", "tail long", None)]
    df = spark.createDataFrame(records + records[:5], "id string, t string, q string").selectExpr("*", "1 as cid", "2 as word", "3 as size")
    for threshold in (0.7, 0.5, 1.0):
        got = near_duplicates.near_duplicate_pairs(df, ("t", "q"), threshold)
        assert rows(got) == brute_pairs(records, threshold)
    assert near_duplicates.near_duplicate_pairs(df.limit(0), ("t", "q"), 0.7).count() == 0


def test_sub_blocks_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SUB_BLOCK", 7)
    monkeypatch.setattr(near_duplicates, "TILE", 5)
    records = edited_texts(5, 90)
    df = spark.createDataFrame(records, "id string, t string, q string")
    assert rows(near_duplicates.near_duplicate_pairs(df, ("t", "q"), 0.6)) == brute_pairs(records, 0.6)


def test_sub_blocks_of_one_index_and_one_probe_row_are_compared(spark, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SUB_BLOCK", 1)
    common = "alpha beta gamma delta epsilon"
    records = [("s1", "alpha beta gamma delta", None), ("s2", common, None)]
    records += [(f"l{k:02d}", common + "".join(f" x{k}y{j}" for j in range(30)), None) for k in range(11)]
    df = spark.createDataFrame(records, "id string, t string, q string")
    assert rows(near_duplicates.near_duplicate_pairs(df, ("t", "q"), 0.7)) == brute_pairs(records, 0.7) == [("s1", "s2")]


def test_near_duplicate_groups(spark):
    records = edited_texts(8, 100)
    got = {r.id: r for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(records, "id string, t string, q string"), ("t", "q"), 0.7).collect()}
    pairs = brute_pairs(records, 0.7)
    group = union_find(pairs)
    assert {i: r.group_id for i, r in got.items()} == {i: group.get(i, i) for i in got}
    sets = {i: words(a, b) for i, a, b in records}
    for i, r in got.items():
        linked = {sets[b if a == i else a] for a, b in pairs if i in (a, b)} - {sets[i]}
        assert r.n_links == len(linked) and r.n_copies == sum(s == sets[i] for s in sets.values())


def subject_texts(seed=2, subjects=6, per=12):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ze", "tu", "ra"]
    coin = lambda: "".join(rng.choices(syllables, k=4)) + rng.choice(["dol", "mer", "rix"])
    out, truth = [], {}
    for s in range(subjects):
        terms = [coin() for _ in range(6)]
        members = [f"c{s}_{k:02d}" for k in range(per if s else 3)]
        for m in members:
            used = rng.sample(terms, rng.randint(4, 6))
            used = [t + "s" if rng.random() < 0.2 else t.upper() if rng.random() < 0.2 else t for t in used]
            out.append((m, f"The {' and the '.join(used)} were seen at Kalodromer Ridge by readers who subscribe"))
            truth[m] = (min(members), len(members))
    return out, truth


def test_clusters_find_subjects(spark, rows):
    records, truth = subject_texts()
    noise = [("n1", None), ("n2", ""), ("n3", "The readers were seen at Kalodromer Ridge"), (None, "x"), ("n4", "word " * 3000)]
    ordinary = "the and were seen at by readers who subscribe word".split()
    df = spark.createDataFrame(records + noise + records[:4], "id string, text string").selectExpr("*", "1 as v", "2 as terms", "3 as label")
    got = clusters.subject_clusters(df, ordinary)
    assert rows(got, "id", "cluster_id") == sorted((m, c) for m, (c, n) in truth.items() if n >= 5)
    described = clusters.describe_clusters(got).collect()
    assert all(r.size == 12 and len(r.typical) <= 3 for r in described) and len(described) == 5
    assert clusters.subject_clusters(df.limit(0), ordinary).count() == 0


def test_every_pair_that_shares_terms_is_linked(spark, rows, monkeypatch):
    rng = random.Random(3)
    weight = {f"t{k}": w for k, w in enumerate([1.0, 1.0, 0.9, 0.8, 1.0, 0.333333, 1.0, 0.1])}
    sets = [sorted(rng.sample(sorted(weight), rng.randint(1, 5))) for _ in range(40)]
    df = spark.createDataFrame([(k, [(t, weight[t]) for t in terms]) for k, terms in enumerate(sets)], "v bigint, terms array<struct<term: string, w: double>>")
    want = []
    for b, late in enumerate(sets):
        for a, early in enumerate(sets[:b]):
            if both := set(late) & set(early):
                want.append((a, b, round(min(1.0, (sum(weight[t] for t in both) / 2) ** 2), 6)))
    assert any(w >= clusters.THRESHOLD for *_, w in want)
    for block in (256, 3):
        monkeypatch.setattr(clusters, "BLOCK", block)
        got = rows(clusters.shared_links(df), "a", "b", "weight")
        assert [g[:2] for g in got] == sorted((w[:2] for w in want), key=repr)
        assert max(abs(g[2] - w[2]) for g, w in zip(got, sorted(want, key=repr), strict=True)) < 2e-6


def test_a_term_of_another_subject_links_but_does_not_merge(spark, rows):
    first, second = (["kalodol", "mizerix", "tuloramer", "zekadol"], ["ralomer", "kamirix", "tuzedol", "lomiramer"])
    rng = random.Random(1)
    texts = [(f"{'ab'[k % 2]}{k:02d}", " and ".join(rng.sample((first, second)[k % 2], 3))) for k in range(24)]
    texts += [("a98", "kalodol and mizerix and ralomer"), ("b99", "tuzedol and lomiramer and zekadol")]
    df = spark.createDataFrame(texts, "id string, text string")
    got = rows(clusters.subject_clusters(df, ["and"]), "id", "cluster_id")
    assert got == sorted((i, "a00" if i[0] == "a" else "b01") for i, _ in texts)
    # the threshold is what keeps them apart
    assert rows(clusters.subject_clusters(df, ["and"], threshold=0.0), "id", "cluster_id") == sorted((i, "a00") for i, _ in texts)


def test_terms_weigh_by_their_company(spark):
    texts = [(k, "kalodol mizerix " + ("reseen Nimeth" if k % 5 == 0 else "scatter")) for k in range(10)] + [(k, "scatter reseen Nimeth"[: 7 + 7 * (k % 3 > 0)]) for k in range(10, 60)]
    words = clusters.rare_words(spark.createDataFrame(texts, "id int, text string"), ["and"])
    weights = {r.term: r.w for r in clusters.term_weights(words).collect()}
    assert weights["kalodol"] == weights["mizerix"] == 1.0 and "nimeth" not in weights


def test_average_linkage_stops_below_the_threshold(spark, rows):
    links = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.2), ("d", "e", 0.9), ("b", "d", 0.3)]
    got = clusters.average_linkage(spark.createDataFrame(links + links[:2], "a string, b string, weight double"), 0.5)
    assert dict(rows(got, "v", "label")) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert components.consolidate(spark.createDataFrame([("a", "b")], "a string, b string")).count() == 2


def test_copies_are_tied_to_the_first_of_their_text(spark, rows):
    near = "one two three four five six seven eight nine ten"
    records = [(f"a{k}", near, None) for k in range(5)] + [("b0", near + " eleven", None), ("b1", near + " eleven", None), ("c0", "other words", None), ("c1", "words other", None)]
    got = rows(near_duplicates.near_duplicate_pairs(spark.createDataFrame(records, "id string, t string, q string"), ("t", "q"), 0.7))
    copies = [("a0", f"a{k}") for k in range(1, 5)] + [("b0", "b1"), ("c0", "c1")]
    across = [(f"a{k}", "b0") for k in range(5)] + [("a0", "b1")]
    assert got == sorted(copies + across)
    assert union_find(got) == union_find(brute_pairs(records, 0.7))


def test_different_texts_of_one_word_set_are_all_paired(spark, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SLICE", 2, raising=False)
    base = "one two three four five six seven eight nine ten".split()
    records = [(f"a{k}", " ".join(base[k:] + base[:k]), None) for k in range(7)]
    records += [(f"b{k}", " ".join(["eleven", *base[k:], *base[:k]]), None) for k in range(5)] + [("b5", records[0][1], "eleven")]
    got = rows(near_duplicates.near_duplicate_pairs(spark.createDataFrame(records, "id string, t string, q string"), ("t", "q"), 0.7))
    assert got == brute_pairs(records, 0.7)


def test_texts_without_a_common_word(spark):
    df = spark.createDataFrame([("a", "one", None), ("b", "two", None)], "id string, t string, q string").coalesce(1)
    assert near_duplicates.near_duplicate_pairs(df, ("t", "q"), 0.7).count() == 0
    assert clusters.subject_clusters(df.selectExpr("id", "t as text"), ["one", "two"]).count() == 0

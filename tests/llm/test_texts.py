import random
import re

import numpy as np
import pytest

from loomgraph.llm import chunking, leakage, mixing
from loomgraph.llm.boilerplate import boilerplate_lines, tree_match
from loomgraph.llm.leakage import ItemIndex, leaked_items
from loomgraph.llm.tokens import TOKEN


def runs(text, n=12):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def leaky(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for k in range(30)]
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary + ["Other", "x-y"], k=rng.randint(0, 60))
        if rng.random() < 0.6:
            source = rng.choice(items)[1].split()
            at = rng.randrange(len(words) + 1)
            cut = rng.randrange(len(source))
            words[at:at] = source[cut : cut + rng.randint(8, 20)]
        docs.append((k, ", ".join(words).upper() if k % 7 == 0 else "  ".join(words)))
    return docs, items


def test_leaks_equal_brute_force(spark, rows):
    docs, items = leaky(1)
    docs += [(900, None), (901, ""), (902, "lead " * 20000 + items[3][1] + " tail" * 20000), (None, items[3][1])]
    items += [(31, None), (32, "too short"), (None, items[0][1]), (33, items[3][1])]
    d = spark.createDataFrame(docs + docs[:3], "doc_id int, text string").selectExpr("*", "1 as item_id")
    i = spark.createDataFrame(items + items[:3], "item_id bigint, text string").selectExpr("*", "2 as doc_id")
    want = sorted((a, b) for a, x in docs if a is not None for b, y in items if b is not None and x and y and runs(x) & runs(y))
    assert rows(leaked_items(d, i), "doc_id", "item_id") == sorted(want, key=repr)
    assert leaked_items(d, i.limit(0)).count() == 0 and leaked_items(d.limit(0), i).count() == 0


def test_retrieval_is_complete():
    _, items = leaky(4)
    index = ItemIndex(items, 12)
    rng = np.random.default_rng(0)
    passages = rng.integers(0, index.none + 1, (300, 24)).astype(np.int32)
    score = np.array([[sum(index.weight[index.cell[t, i // 16], i % 16] for t in set(p)) for i in range(len(index.ids))] for p in passages])
    rows, got = index.retrieve(passages)
    assert set(zip(rows, got, strict=True)) == set(zip(*np.nonzero(score >= 1 - 1e-4), strict=True))


def test_every_run_of_an_item_reaches_the_threshold():
    _, items = leaky(6)
    index = ItemIndex(items, 12)
    for item, words in enumerate(index.words):
        for s in range(len(words) - 11):
            passage = np.full((1, 24), index.none, dtype=np.int32)
            passage[0, s % 12 : s % 12 + 12] = words[s : s + 12]
            assert item in index.retrieve(passage)[1]


def test_only_what_the_index_retrieves_is_reported(monkeypatch):
    docs, items = leaky(1)
    texts = [t for _, t in docs]
    every = ItemIndex(items, 12).leaks(texts)
    lost = every[0][1]
    whole = ItemIndex.retrieve

    def misses(self, passages):
        rows, found = whole(self, passages)
        return rows[found != lost], found[found != lost]

    monkeypatch.setattr(ItemIndex, "retrieve", misses)
    assert sorted(ItemIndex(items, 12).leaks(texts)) == sorted(x for x in every if x[1] != lost) != sorted(every)


def test_shards_and_portions_of_a_batch_change_nothing(spark, rows, monkeypatch):
    docs, items = leaky(2)
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = rows(leakage.leaked_items(d, i))
    monkeypatch.setattr(leakage, "SHARD_BYTES", 300)
    assert rows(leakage.leaked_items(d, i)) == whole
    few = ItemIndex(items, 12).leaks([t for _, t in docs])
    monkeypatch.setattr(leakage, "WORDS_AT_ONCE", 100)
    assert sorted(ItemIndex(items, 12).leaks([t for _, t in docs])) == sorted(few)


def test_words_of_the_question_are_told_apart(spark, rows):
    asked = "Passage: one two three four five six seven eight nine ten eleven twelve. What follows from all that was said in the passage of the twelve numbers?"
    docs = [(1, "ONE two three four five six seven eight nine ten eleven twelve - and more"), (2, "he asked what follows from all that was said in the passage of the twelve sages")]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(7, asked)], "item_id int, text string"))
    assert rows(got) == [(1, 7, 12, 0), (2, 7, 13, 13)]


def long_text(seed, n=6000, breaks=True):
    rng = random.Random(seed)
    parts = []
    for _ in range(n):
        parts.append(rng.choice(["alpha", "βήτα", "gamma2", "delta", "ε"]) + (rng.choice([". ", ".\n", "!\n\n", ", ", "; "]) if breaks and rng.random() < 0.1 else " "))
    return "".join(parts)


@pytest.mark.parametrize("text", [long_text(1), long_text(2, 2000, False), "x" * 9000, "? " * 3000, long_text(3, 1100)])
def test_pieces_cover_the_text(text):
    n = len(TOKEN.findall(text))
    pieces = chunking.split_text(text, 1024, 64)
    assert pieces[0][0] == 0 and pieces[-1][1] == n and pieces[0][2] == 0 and pieces[-1][3] == len(text)
    for (a, b, c, d), (e, f, g, h) in zip(pieces, pieces[1:], strict=False):
        assert e == b - 64 and f > b and g < d <= h
    assert all(0 < b - a <= 1024 for a, b, *_ in pieces) or n <= 1024
    for a, b, c, d in pieces:
        assert len(TOKEN.findall(text[c:d])) == b - a


def test_edits_move_only_neighbouring_cuts():
    text = long_text(5, 20000)
    spans = [m.span() for m in TOKEN.finditer(text)]
    at = spans[len(spans) // 3][0]
    edited = text[:at] + "inserted words here " + text[at:]
    ends = lambda t: {t[:d][-40:] for _, _, _, d in chunking.split_text(t, 1024, 64)}
    assert len(ends(text) & ends(edited)) >= len(ends(text)) * 0.6


def test_split_query_cases(spark, rows):
    data = [(1, "a " * 1024), (2, "a " * 1025), (3, None), (4, ""), (5, "a" * 5000)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 as piece", "2 as piece_no")
    got = chunking.split_oversized(df)
    assert rows(got, "doc_id", "piece_no", "first_token", "end_token")[0][:3] == (2, 0, 0) and {r.doc_id for r in got.collect()} == {2}
    with pytest.raises(ValueError, match="overlap"):
        chunking.split_oversized(df, 100, 60)


def test_knapsack_is_exact_within_its_stretch():
    rng = random.Random(1)
    for _ in range(60):
        lengths = {n: rng.randint(1, 4) for n in rng.sample(range(3, 40), 5)}
        budget = rng.randint(0, 150)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + k * n for s in sums for k in range(c + 1)}
        taken = mixing.knapsack(lengths, budget)
        total = sum(n * c for n, c in taken.items())
        assert total == max(s for s in sums if s <= budget) and all(0 <= taken[n] <= c for n, c in lengths.items())
    big = {n: 4000 for n in range(50, 900, 7)}
    budget = sum(n * c for n, c in big.items()) // 3
    assert sum(n * c for n, c in mixing.knapsack(big, budget).items()) == budget


def test_mix_meets_shares_and_repeats(spark):
    rng = random.Random(3)
    names = ["News Report", "news_report ", "BLOG", "blog", None, "unlisted"]
    docs = [(k, " ".join(["w"] * rng.randint(0, 90)), rng.choice(names)) for k in range(900)]
    docs += [(2000, None, "blog"), (2001, "", "blog")]
    targets = [("news_report", 0.75, 3), ("blog", 0.25, 1), ("blog", 0.25, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 as n_tokens", "2 as copies")
    chosen, report = mixing.mix_sources(d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    picked = chosen.collect()
    size = {k: len((t or "").split()) for k, t, _ in docs}
    used = {}
    for r in picked:
        assert r.n_tokens == size[r.doc_id] > 0 and 1 <= r.copies <= {"news_report": 3, "blog": 1}[r.source]
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
    assert len({r.doc_id for r in picked}) == len(picked)
    for r in report.collect():
        assert r.tokens_used == used[r.source] == r.tokens_wanted or abs(r.tokens_wanted - r.tokens_used) <= 1
        assert abs(r.actual_share - r.target_share) < 0.001
    none, empty = mixing.mix_sources(d.limit(0), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    assert none.count() == 0 and {r.tokens_used for r in empty.collect()} == {0}


def pages(seed=0, n=60):
    """Pages of two hosts with known furniture; a third of the pages are bare."""
    rng = random.Random(seed)
    nouns = ["harbor", "ledger", "canal", "quota", "tunnel", "archive", "beacon", "spindle"]
    out, truth = [], set()
    for k in range(2 * n):
        host = "one.example" if k % 2 else "two.test"
        body = [f"The {rng.choice(nouns)} of {rng.choice(nouns)} was closed by {rng.choice(nouns)} {rng.randint(2, 99)} in {rng.choice(nouns)}." for _ in range(rng.randint(2, 6))]
        body.insert(1, f"Why the {rng.choice(nouns)} matters")
        lines = [(x, False) for x in body]
        if rng.random() < 0.7:
            menu = [("Home | Topics | Press | Log in", True)] if k % 2 else [(x, True) for x in ("Home", "Topics", "Press")]
            middle = (f"Related: The {rng.choice(nouns)} and the {rng.choice(nouns)}", True)
            lines = [(f"We use cookies on {host}. Accept | Refuse", True), *menu, ("", None), *lines[:2], middle, *lines[2:], (f"Copyright {rng.randint(1999, 2024)} {host}. All rights reserved.", True), ("Subscribe to all letters", True)]
        out.append((k, f"https://{host}/p/{k}", "\n".join(x for x, _ in lines)))
        truth |= {(k, j) for j, (_, flag) in enumerate(lines) if flag}
    return out, truth


def test_boilerplate_finds_furniture(spark, rows):
    data, truth = pages()
    again = [(1000, data[1][1], data[1][2]), data[0]]
    odd = [(2000, None, "x\ny"), (2001, "https://one.example/p/e", ""), (2002, "https://one.example/p/n", None), (None, data[3][1], "z"), (2003, "https://lone.example/a", "Some text\nof its own"), (2004, None, "A page without an address\nSubscribe to all letters\nends here")]
    df = spark.createDataFrame(data + again + odd, "id bigint, url string, text string").selectExpr("*", "1 as page", "2 as host", "3 as line")
    got = {tuple(r) for r in boilerplate_lines(df).collect()}
    want = truth | {(1000, j) for k, j in truth if k == 1} | {(2004, 1)}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert boilerplate_lines(df.limit(0)).count() == 0


def test_tree_match_keeps_order():
    a = [("x",), ("a", "b"), ("c",), ("y",)]
    b = [("c",), ("a", "q", "b"), ("c",), ("y", "z")]
    assert tree_match(a, b) == [(1, 1), (2, 2), (3, 3)]
    assert np.array_equal(tree_match([], b), [])

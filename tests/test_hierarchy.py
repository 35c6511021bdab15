import random
from collections import Counter

from loomgraph.operators.hierarchy import descendant_pairs, resolve_hierarchy, supersession_links


def walk(parent):
    """Root, depth and path of every node by following parents one by one."""
    out = {}
    for v in {*parent, *parent.values()}:
        path, seen = [v], {v}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if path[-1] in parent:
            start = path.index(parent[path[-1]])
            out[v] = (min(path[start:]), -1, None)
        else:
            out[v] = (path[-1], len(path) - 1, path)
    return out


def check(spark, pairs):
    parent = {}
    for c, p in pairs:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    expected = walk(parent)
    df = resolve_hierarchy(spark.createDataFrame(pairs, "child string, parent string").selectExpr("*", "1 as v", "2 as p"), with_paths=True)
    got = {r.node: r for r in df.collect()}
    assert {k: (r.root, r.depth, r.path) for k, r in got.items()} == expected
    below = Counter(a for _, _, path in expected.values() if path for a in path[1:])
    assert all(got[v].n_descendants == below[v] for v, e in expected.items() if e[2])
    return df, below


def test_random_forests_with_loops(spark):
    rng = random.Random(4)
    nodes = [f"n{k:03d}" for k in range(120)]
    pairs = [(v, rng.choice(nodes)) for v in rng.sample(nodes, 90)]
    pairs += [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("t", "l2"), ("s", "s")]
    df, below = check(spark, pairs + pairs[:5] + [(None, "n001"), ("n002", None)])
    assert descendant_pairs(df).count() == sum(below.values())


def test_star_of_many_children(spark):
    check(spark, [(f"k{k}", "hub") for k in range(200)] + [("hub", "top")])


def test_empty(spark):
    assert resolve_hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_links_ignore_case_blanks_and_foreign_ids(spark, rows):
    events = [("E1", None), (" e2 ", "e1"), ("e2", " E1"), ("e3", "clm_1"), ("e4", ""), (None, "e1")]
    df = spark.createDataFrame(events, "event_id string, supersedes string")
    assert rows(supersession_links(df), "child", "parent") == [("e2", "e1")]

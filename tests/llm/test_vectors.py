import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import queries
from loomgraph.llm.vector_neighbours import SCALE, exact_vectors, greedy_search, neighbour_graph, recall, similar_vectors, usable_vectors

DIM = 16
LARGE = "/root/testdata/sf0.1"


def clustered(n=900, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, DIM))
    return centers[rng.integers(20, size=n)] + 0.4 * rng.normal(size=(n, DIM))


def frame(spark, x):
    return spark.createDataFrame([(f"v{k:04d}", [float(f) for f in v]) for k, v in enumerate(x)], "id string, vector array<float>")


def truth(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k], s


def test_recall_and_similarities(spark):
    x = clustered()
    best, sims = truth(x)
    df = frame(spark, x).selectExpr("*", "1 as n", "2 as sim", "3 as other")
    got = similar_vectors(df, DIM, 5, width=16, passes=3, rounds=5).collect()
    assert len(got) == 5 * len(x)
    found = {}
    for r in got:
        a, b = int(r.a[1:]), int(r.b[1:])
        found.setdefault(a, set()).add(b)
        assert abs(r.similarity - sims[a, b]) < 1e-5
    assert np.mean([len(found[k] & set(best[k])) / 5 for k in range(len(x))]) >= 0.95


def test_greedy_search_recall(spark):
    x = clustered(seed=3)
    best, _ = truth(x)
    units = usable_vectors(frame(spark, x), DIM)
    nodes, graph = neighbour_graph(units, DIM, width=16, passes=3, rounds=4)
    got = greedy_search(units.where("cast(substr(id, 2) as int) % 20 = 0"), nodes, graph, DIM).collect()
    found = {}
    for r in got:
        found.setdefault(int(r.a[1:]), set()).add(int(r.b[1:]))
    assert len(found) == 45
    assert np.mean([len(found[k] & set(best[k])) / 5 for k in found]) >= 0.9


def test_unusable_few_and_equal_vectors(spark, rows):
    good = [1.0] + [0.0] * (DIM - 1)
    data = [("a", good), ("a", good), ("b", [2 * v for v in good]), ("c", [0.5, 1.0] + [0.0] * (DIM - 2)), ("d", None), ("e", [1.0]), ("f", [0.0] * DIM), ("g", [float("nan")] + good[1:]), ("h", [float("inf")] + good[1:]), ("i", [None] + good[1:]), (None, good)]
    df = spark.createDataFrame(data, "id string, vector array<float>")
    assert rows(usable_vectors(df, DIM), "id") == [("a",), ("b",), ("c",)]
    got = similar_vectors(df, DIM, 5, width=4, passes=1, rounds=2)
    assert {(r.a, r.b) for r in got.collect()} == {(x, y) for x in "abc" for y in "abc" if x != y}
    assert similar_vectors(df.where("id = 'a'"), DIM).count() == 0 and similar_vectors(df.limit(0), DIM).count() == 0


def test_search_enters_near_queries_however_many_vectors(spark):
    # vectors that resemble only the few before and after them: nothing leads there from afar
    rng = np.random.default_rng(5)
    n, span = 3000, 12
    steps = rng.standard_normal((n + span, 64))
    sums = np.cumsum(np.vstack([np.zeros((1, 64)), steps]), axis=0)
    rows = sums[span : n + span] - sums[:n]
    rows = (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)
    codes = np.rint(rows * SCALE).astype(np.int8)
    nodes = spark.createDataFrame([(k, f"v{k}", bytearray(rows[k].tobytes()), bytearray(codes[k].tobytes())) for k in range(n)], "n bigint, id string, unit binary, code binary")
    near = [np.array([j for j in range(k - 3, k + 4) if j != k and 0 <= j < n], dtype=np.int64) for k in range(n)]
    graph = spark.createDataFrame([(k, bytearray(near[k].tobytes())) for k in range(n)], "n bigint, others binary")
    asked = list(range(7, n, 50))
    got = greedy_search(nodes.where(F.col("n") % 50 == 7).select("id", "unit"), nodes, graph).collect()
    sims = rows[asked] @ rows.T
    sims[np.arange(len(asked)), asked] = -9
    truth = {f"v{q}": {f"v{j}" for j in np.argsort(-s)[:5]} for q, s in zip(asked, sims, strict=True)}
    assert sum(r.b in truth[r.a] for r in got) >= 0.9 * 5 * len(asked)


def test_comparing_all_equals_brute_force(spark):
    x = clustered(300, 7)
    best, sims = truth(x)
    df = frame(spark, x)
    got = {}
    for r in exact_vectors(df, DIM, 5, block=64).collect():
        got.setdefault(int(r.a[1:]), []).append((r.rank, int(r.b[1:])))
        assert abs(r.similarity - sims[int(r.a[1:]), int(r.b[1:])]) < 1e-5
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == {k: list(best[k]) for k in range(300)}
    some = exact_vectors(df, DIM, 5, df.where("id < 'v0010'"), block=64)
    assert some.count() == 50 and recall(some, some) == 1.0 and recall(some.where("rank < 5"), some) == 0.8
    assert exact_vectors(df.limit(1), DIM).count() == 0 and recall(df.limit(0).selectExpr("id as a", "id as b"), df.limit(0).selectExpr("id as a", "id as b")) == 1.0


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="test tables are not here")
def test_recall_on_the_tables(spark):
    vectors = queries._vectors(spark, LARGE)
    asked = vectors.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 20 == 0)
    exact = exact_vectors(vectors, 64, 5, asked).cache()
    assert exact.select("a").distinct().count() > 400
    assert recall(queries.p2_search(spark, LARGE).toDF("a", "b", "similarity", "rank"), exact) >= 0.93
    assert recall(queries.p2_similar(spark, LARGE).toDF("a", "b", "similarity", "rank"), exact) >= 0.97

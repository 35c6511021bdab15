"""The most similar vectors of every vector, by NN-descent.

A first neighbour graph comes from sorting the vectors along random hyperplane codes and
comparing them within consecutive runs. Each round then joins the neighbours of
neighbours: every vector is sent to the vectors it is linked with in either direction,
those that meet there are compared in one matrix product, and each keeps what beats its
present neighbours. Pairs that met in an earlier round are not compared again. Rounds end
when few lists change. Vectors travel as one byte per number; the lists are re-scored on
the full vectors at the end. Queries walk the graph greedily from entry points of their runs.

The graph has ``width`` neighbours per vector, so what is joined grows with the number of
vectors and not with its square. A vector that very many others are linked to (a hub)
compares a random part of them per round, as the method has it: no task holds an unbounded
group. Where the loss in accuracy is not acceptable, ``exact_vectors`` compares all, at the
cost of all pairs; ``recall`` measures what the graph finds of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.frames import whole_groups
from loomgraph.session import Scratch

RUN = 256  # vectors compared with one another in the first graph
SCALE = 127.0
#: Linked vectors compared at one vector in a round; of more, a random part.
MEET = 64


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``id, unit``: one unit vector (float32 bytes) per id with ``dim`` finite numbers, not all zero.

    Null ids and vectors, other lengths, NaN, infinities and zero vectors are left out;
    of several usable rows of one id the smallest bytes are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, units = [], []
            if len(batch):
                rows = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vector"]])
                top = np.abs(rows).max(1)
                good = np.isfinite(rows).all(1) & (top > 0)
                rows = rows[good] / top[good][:, None]
                rows /= np.linalg.norm(rows, axis=1)[:, None]
                ids = batch["id"][good].tolist()
                units = [r.tobytes() for r in rows.astype(np.float32)]
            if units:
                yield pd.DataFrame({"id": ids, "unit": units})

    rows = vectors.select("id", "vector").where(F.col("id").isNotNull() & (F.size("vector") == dim))
    rows = rows.where(~F.exists("vector", lambda x: x.isNull()))
    units = rows.mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, unit binary")
    return units.groupBy("id").agg(F.min("unit").alias("unit"))


def _stack(column: pd.Series, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), width)


def _top_lists(owner, other, sim, new, width: int):
    """Per owner the ``width`` best distinct others; rows sorted by owner, then falling sim.

    ``new`` is false if any row of the pair has it false.
    """
    order = np.lexsort((new, other, owner))
    owner, other, sim, new = owner[order], other[order], sim[order], new[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sim, new = owner[first], other[first], sim[first], new[first]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, new = owner[order], other[order], sim[order], new[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    keep = rank < width
    return owner[keep], other[keep], sim[keep], new[keep]


LISTS = "n bigint, other bigint, sim float, new boolean"


def _frame(owner, other, sim, new) -> pd.DataFrame:
    return pd.DataFrame({"n": owner, "other": other, "sim": sim.astype(np.float32), "new": new})


def _first_graph(nodes: DataFrame, dim: int, width: int, passes: int, tasks: int) -> DataFrame:
    """Neighbours within runs of vectors sorted by random hyperplane codes."""
    every = None
    for k in range(passes):
        planes = np.random.default_rng(1000 + k).standard_normal((dim, 25)).astype(np.float32)

        def code(batches: Iterator[pd.DataFrame], planes=planes) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    side = _stack(batch["code"], np.int8, dim).astype(np.float32) @ planes
                    bits = (side[:, :24] > 0) @ (1 << np.arange(24)[::-1])
                    yield pd.DataFrame({"bucket": bits.astype(np.int64), "along": side[:, 24], "n": batch["n"], "code": batch["code"]})

        def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n = batch["n"].to_numpy()
                x = _stack(batch["code"], np.int8, dim).astype(np.float32) / SCALE
                parts = []
                for s in range(0, len(n), RUN):
                    e = min(len(n), s + RUN)
                    if e - s < 2:
                        continue
                    sims = x[s:e] @ x[s:e].T
                    np.fill_diagonal(sims, -9)
                    take = min(width, e - s - 1)
                    best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                    parts.append((np.repeat(n[s:e], take), n[s:e][best].ravel(), np.take_along_axis(sims, best, 1).ravel()))
                if parts:
                    owner, other, sim = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield _frame(owner, other, sim, np.ones(len(owner), dtype=bool))

        coded = nodes.select("n", "code").mapInPandas(code, "bucket bigint, along float, n bigint, code binary")
        near = coded.repartitionByRange(tasks, "bucket", "along").sortWithinPartitions("bucket", "along").mapInPandas(within, LISTS)
        every = near if every is None else every.unionByName(near)
    return every


def _merge(lists: DataFrame, width: int, tasks: int) -> DataFrame:
    """The best ``width`` of each vector, one row per vector: ``n, others, sims, news``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ("n",)):
            owner, other, sim, new = _top_lists(
                part["n"].to_numpy(), part["other"].to_numpy(), part["sim"].to_numpy(), part["new"].to_numpy(dtype=bool), width
            )
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            ends = np.r_[starts[1:], len(owner)]
            rows = [(other[s:e].tobytes(), sim[s:e].tobytes(), new[s:e].tobytes(), int(new[s:e].sum()), float(sim[e - 1]) if e - s == width else -9.0) for s, e in zip(starts, ends, strict=True)]
            out = pd.DataFrame(rows, columns=["others", "sims", "news", "fresh", "floor"])
            yield out.assign(n=owner[starts])[["n", "others", "sims", "news", "fresh", "floor"]]

    schema = "n bigint, others binary, sims binary, news binary, fresh int, floor float"
    return lists.repartition(tasks, "n").sortWithinPartitions("n").mapInPandas(run, schema)


def _lists(graph: DataFrame, settle: bool) -> DataFrame:
    """Back to one row per neighbour; ``settle`` marks them as compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                count = [len(b) // 8 for b in batch["others"]]
                new = np.frombuffer(b"".join(batch["news"]), dtype=bool)
                yield _frame(
                    np.repeat(batch["n"].to_numpy(), count), np.frombuffer(b"".join(batch["others"]), dtype=np.int64),
                    np.frombuffer(b"".join(batch["sims"]), dtype=np.float32), np.zeros(len(new), dtype=bool) if settle else new,
                )

    return graph.select("n", "others", "sims", "news").mapInPandas(run, LISTS)


def _meetings(graph: DataFrame, dim: int, keep: int, seed: int, tasks: int) -> DataFrame:
    """What vectors learn about one another where they are linked to a common vector."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                count = [len(b) // 8 for b in batch["others"]]
                one = np.repeat(batch["n"].to_numpy(), count)
                two = np.frombuffer(b"".join(batch["others"]), dtype=np.int64)
                new = np.frombuffer(b"".join(batch["news"]), dtype=bool)
                yield pd.DataFrame({"member": np.r_[one, two], "center": np.r_[two, one], "new": np.r_[new, new]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for part in whole_groups(batches, ("center",)):
            center = part["center"].to_numpy()
            member, new, floor = part["member"].to_numpy(), part["new"].to_numpy(dtype=bool), part["floor"].to_numpy()
            code = _stack(part["code"], np.int8, dim)
            order = np.lexsort((rng.random(len(center)), ~new, center))
            starts = np.flatnonzero(np.r_[True, center[order][1:] != center[order][:-1]])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            for s in range(0, len(starts), 512):
                lo, hi = starts[s], starts[s + 512] if s + 512 < len(starts) else len(order)
                at = order[lo:hi]
                inside = rank[lo:hi] < MEET
                at, r = at[inside], rank[lo:hi][inside]
                g = np.cumsum(r == 0) - 1
                m = int(r.max()) + 1
                groups = int(g[-1]) + 1
                who = np.full((groups, m), -1, dtype=np.int64)
                who[g, r] = member[at]
                fresh = np.zeros((groups, m), dtype=bool)
                fresh[g, r] = new[at]
                least = np.full((groups, m), 9.0, dtype=np.float32)
                least[g, r] = floor[at]
                x = np.zeros((groups, m, dim), dtype=np.float32)
                x[g, r] = code[at]
                sims = np.matmul(x, x.transpose(0, 2, 1)) / np.float32(SCALE * SCALE)
                worth = (sims > least[:, :, None]) & (fresh[:, :, None] | fresh[:, None, :]) & (who >= 0)[:, None, :]
                worth &= who[:, :, None] != who[:, None, :]
                sims[~worth] = -9
                take = min(keep, m)
                best = np.argpartition(-sims, take - 1, axis=2)[:, :, :take] if take < m else np.broadcast_to(np.arange(m), sims.shape)
                got = np.take_along_axis(sims, best, 2)
                i, j, k = np.nonzero(got > -9)
                if len(i):
                    owner, other, sim, flag = _top_lists(who[i, j], who[i, best[i, j, k]], got[i, j, k], np.ones(len(i), dtype=bool), 1 << 30)
                    yield _frame(owner, other, sim, flag)

    pairs = graph.select("n", "others", "news").mapInPandas(links, "member bigint, center bigint, new boolean")
    pairs = pairs.groupBy("member", "center").agg(F.max("new").alias("new"))
    sent = pairs.join(graph.select(F.col("n").alias("member"), "code", "floor"), "member")
    return sent.repartition(tasks, "center").sortWithinPartitions("center", "member").mapInPandas(meet, LISTS)


def neighbour_graph(units: DataFrame, dim: int, width: int = 32, passes: int = 6, rounds: int | None = None, settled: float = 0.02, keep: int = 6, seed: int = 1):
    """``(nodes, graph)``: ``nodes(n, id, unit, code)`` and ``graph(n, others, sims, news, ...)``.

    Rounds stop when less than ``settled`` of all list entries changed, or after ``rounds`` if
    given. Lists only ever improve, so they do settle.
    """
    spark = units.sparkSession
    scratch = Scratch(spark, "neighbours")

    nodes, held = scratch.keep(_with_code(units.select("id", "unit").withColumn("n", F.monotonically_increasing_id()), dim))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held * width // 250_000)
    runs = max(1, min(tasks, held // (4 * RUN)))
    codes = nodes.select("n", "code")
    graph, _ = scratch.keep(_merge(_first_graph(nodes, dim, width, passes, runs), width, tasks).join(codes, "n"))
    for turn in count() if rounds is None else range(rounds):
        learnt = _meetings(graph, dim, keep, seed + turn, tasks)
        merged = _merge(learnt.unionByName(_lists(graph, True)), width, tasks).join(codes, "n")
        previous = graph
        graph, seen = scratch.keep_with(merged, fresh=F.sum("fresh"))
        scratch.drop(previous)
        scratch.release()
        if (seen["fresh"] or 0) <= settled * held * width:
            break
    return nodes, graph


def _exact(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (_stack(batch[c], np.float32, dim).astype(np.float64) for c in ("ua", "ub"))
                yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": np.einsum("ij,ij->i", x, y)})

    return run


def _with_code(rows: DataFrame, dim: int) -> DataFrame:
    """Adds ``code``, one byte per number, to rows with a ``unit`` vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _stack(batch["unit"], np.float32, dim)
                yield batch.assign(code=[r.tobytes() for r in np.rint(x * SCALE).astype(np.int8)])

    return rows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", code binary")


def _scored(lists: DataFrame, nodes: DataFrame, dim: int, k: int, tasks: int) -> DataFrame:
    """``a, b, similarity, rank``: the ``k`` best of each ``n``, by full vectors."""

    kind = dict(nodes.dtypes)["id"]
    left = nodes.select("n", F.col("id").alias("a"), F.col("unit").alias("ua"))
    right = nodes.select(F.col("n").alias("other"), F.col("id").alias("b"), F.col("unit").alias("ub"))
    pairs = lists.select("n", "other").join(right, "other").join(left, "n").select("a", "b", "ua", "ub")
    sims = pairs.mapInPandas(_exact(dim), f"a {kind}, b {kind}, similarity double")
    best = sims.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("similarity"), F.col("b"))), False), 1, k).alias("best"))
    return best.select("a", F.posexplode("best").alias("rank", "x")).select("a", "x.b", "x.similarity", F.col("rank") + 1)


def similar_vectors(vectors: DataFrame, dim: int = 64, k: int = 5, **options) -> DataFrame:
    """``a, b, similarity, rank``: the ``k`` most similar others of every usable vector.

    ``vectors(id, vector)``; what is usable says :func:`usable_vectors`. With fewer than
    two usable vectors the result is empty; with at most ``k`` each has all others. Equal
    vectors are neighbours with similarity 1. Extra columns are ignored.
    """
    nodes, graph = neighbour_graph(usable_vectors(vectors, dim), dim, **options)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # twice as many as asked for: the byte vectors order neighbours closely, not exactly
        for batch in batches:
            if len(batch):
                lists = [np.frombuffer(b, dtype=np.int64)[: 2 * k] for b in batch["others"]]
                yield pd.DataFrame({"n": np.repeat(batch["n"].to_numpy(), [len(x) for x in lists]), "other": np.concatenate(lists)})

    return _scored(graph.select("n", "others").mapInPandas(front, "n bigint, other bigint"), nodes, dim, k, tasks).toDF("a", "b", "similarity", "rank")


def exact_vectors(vectors: DataFrame, dim: int = 64, k: int = 5, queries: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """``a, b, similarity, rank``: the ``k`` most similar others by comparing all.

    ``queries(id)`` restricts whose neighbours are asked for. Vectors are dealt into blocks; each
    block of queries meets each block of vectors in one matrix product and keeps its best, so a
    task holds two blocks. Ties go to the larger id, as with :func:`similar_vectors`.
    """
    scratch = Scratch(vectors.sparkSession, "exact")
    units, held = scratch.keep(usable_vectors(vectors, dim))
    blocks = max(1, -(-held // block))
    dealt = units.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = dealt if queries is None else dealt.join(queries.select("id").distinct(), "id", "left_semi")
    every = asked.select("id", "unit", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks")).union(
        dealt.select("id", "unit", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
    )
    kind = dict(vectors.dtypes)["id"]

    def best(group: pd.DataFrame) -> pd.DataFrame:
        x, asks, ids = _stack(group["unit"], np.float32, dim).astype(np.float64), group["asks"].to_numpy(), group["id"].to_numpy()
        a, b = ids[asks], ids[~asks]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": a[:0], "b": b[:0], "similarity": np.zeros(0)})
        sims = x[asks] @ x[~asks].T
        sims[a[:, None] == b[None, :]] = -9
        take = min(k, len(b))
        least = -np.partition(-sims, take - 1, axis=1)[:, take - 1 : take]
        i, j = np.nonzero((sims >= least) & (sims > -9))
        return pd.DataFrame({"a": a[i], "b": b[j], "similarity": sims[i, j]})

    near = every.groupBy("i", "j").applyInPandas(best, f"a {kind}, b {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), F.desc("b")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "similarity", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours ``a, b`` that were found; 1 where there are none."""
    rows = exact.select("a", "b").join(found.select("a", "b", F.lit(1).alias("hit")).distinct(), ["a", "b"], "left")
    return rows.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def _routed(asked: DataFrame, nodes: DataFrame, dim: int, keep: int, passes: int, tasks: int) -> DataFrame:
    """``a, n``: for each query the ``keep`` best vectors of its run in each pass.

    Queries are sorted among the vectors along the hyperplane codes of the first graph, so
    entry points lie near them however many vectors there are.
    """
    kind = dict(asked.dtypes)["a"]
    both = nodes.select(F.lit(None).cast(kind).alias("a"), "n", "code").union(asked.select("a", F.lit(-1).cast("bigint").alias("n"), F.col("ca").alias("code")))
    every = None
    for k in range(passes):
        planes = np.random.default_rng(1000 + k).standard_normal((dim, 25)).astype(np.float32)

        def code(batches: Iterator[pd.DataFrame], planes=planes) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    side = _stack(batch["code"], np.int8, dim).astype(np.float32) @ planes
                    bits = (side[:, :24] > 0) @ (1 << np.arange(24)[::-1])
                    yield pd.DataFrame({"bucket": bits.astype(np.int64), "along": side[:, 24], "a": batch["a"], "n": batch["n"], "code": batch["code"]})

        def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _stack(batch["code"], np.int8, dim).astype(np.float32) / SCALE
                n, a = batch["n"].to_numpy(), batch["a"].to_numpy()
                for s in range(0, len(n), RUN):
                    part = np.arange(s, min(len(n), s + RUN))
                    ask, have = part[n[part] < 0], part[n[part] >= 0]
                    take = min(keep, len(have))
                    if len(ask) and take:
                        best = np.argpartition(-(x[ask] @ x[have].T), take - 1, axis=1)[:, :take]
                        yield pd.DataFrame({"a": np.repeat(a[ask], take), "n": n[have][best].ravel()})

        coded = both.mapInPandas(code, f"bucket bigint, along float, a {kind}, n bigint, code binary")
        near = coded.repartitionByRange(tasks, "bucket", "along").sortWithinPartitions("bucket", "along").mapInPandas(within, f"a {kind}, n bigint")
        every = near if every is None else every.unionByName(near)
    return every


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, dim: int = 64, k: int = 5, beam: int = 48, open_per_step: int = 8, passes: int = 6) -> DataFrame:
    """``a, b, similarity, rank``: the ``k`` best that a greedy walk of the graph finds.

    ``queries(id, unit)`` as from :func:`usable_vectors`; a query is never its own result.
    Each query enters at vectors near it in the runs of ``passes`` hyperplane codes and at
    some drawn by hash, keeps a beam of the best vectors seen, opens the best unopened of
    them and adds their neighbours, until nothing in its beam is unopened. What leaves the
    beam never comes back, so the walk ends.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "search")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(queries.dtypes)["id"]
    asked, _ = scratch.keep(_with_code(queries.select("id", "unit"), dim).select(F.col("id").alias("a"), F.col("unit").alias("ua"), F.col("code").alias("ca")))
    # a fixed number of entry points for all queries, drawn by hash
    entry = [r[0] for r in nodes.select("n").orderBy(F.xxhash64("n", F.lit(17))).limit(beam).collect()]
    runs = max(1, min(tasks, nodes.count() // (4 * RUN)))
    reached = _routed(asked, nodes, dim, beam // 2, passes, runs)
    if entry:
        reached = reached.union(asked.select("a", F.explode(F.lit(entry)).alias("n")))
    reached = reached.distinct()
    vectors = nodes.select("n", F.col("id").alias("b"), F.col("code").alias("cb"))

    def closely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (_stack(batch[c], np.int8, dim).astype(np.float32) / SCALE for c in ("ca", "cb"))
                yield pd.DataFrame({"a": batch["a"], "n": batch["n"], "b": batch["b"], "similarity": np.einsum("ij,ij->i", x, y).astype(np.float64)})

    def measured(pairs: DataFrame) -> DataFrame:
        sent = pairs.join(vectors, "n").join(asked.select("a", "ca"), "a").where("a <> b")
        return sent.mapInPandas(closely, f"a {kind}, n bigint, b {kind}, similarity double").withColumn("opened", F.lit(False))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                count = [len(x) // 8 for x in batch["others"]]
                yield pd.DataFrame({"a": np.repeat(batch["a"].to_numpy(), count), "n": np.frombuffer(b"".join(batch["others"]), dtype=np.int64)})

    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    front = measured(reached)
    while True:
        front = front.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam)
        closed = F.row_number().over(Window.partitionBy("a", "opened").orderBy(F.desc("similarity"), "b"))
        front = front.withColumn("open", ~F.col("opened") & (closed <= open_per_step))
        front, seen = scratch.keep_with(front, open=F.count_if("open"))
        if not seen["open"]:
            break
        opened = front.where("open").select("a", "n").join(graph.select("n", "others"), "n").select("a", "others")
        fresh = opened.mapInPandas(members, f"a {kind}, n bigint").distinct().join(front.select("a", "n"), ["a", "n"], "left_anti")
        old = front.select("a", "n", "b", "similarity", (F.col("opened") | F.col("open")).alias("opened"))
        front = old.unionByName(measured(fresh).repartition(tasks, "a"))
    # the byte vectors order closely, the full ones exactly
    last = front.where(F.col("rank") <= 2 * k).select("a", "n")
    last = last.join(asked.select("a", "ua"), "a").join(nodes.select("n", F.col("id").alias("b"), F.col("unit").alias("ub")), "n")
    sims = last.mapInPandas(_exact(dim), f"a {kind}, b {kind}, similarity double")
    ranked = sims.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b")))
    return ranked.where(F.col("rank") <= k).select("a", "b", "similarity", "rank")

"""Closures, cruxes and settling over the claim graph.

Frontiers advance for all roots or targets together: a round is one join against the
edges and one anti join against what is known, whatever the number of roots. Where only
sums or counts over what is reached are asked for, a root is a bit and no pair is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import binary_entropy
from loomgraph.functions.text import is_verdict
from loomgraph.session import Scratch, shuffled

CASCADE = ("supports", "depends_on", "is_crux_for")
UPSTREAM = ("supports", "depends_on")


def active_edges(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return edges.where((F.col("status") == "active") & F.col("edge_type").isin(*types) & F.col("source").isNotNull() & F.col("target").isNotNull())


def in_degrees(edges: DataFrame, types: tuple[str, ...] = CASCADE) -> DataFrame:
    """``claim_id, in_degree``; parallel edges count each."""
    return active_edges(edges, types).groupBy(F.col("target").alias("claim_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def reach(edges: DataFrame, starts: DataFrame, most: int | None, backward: bool = False) -> DataFrame:
    """``root, node, depth``: nodes within ``most`` steps of each root, least depth, root left out.

    ``starts(root)``; ``edges(source, target)``. Backward follows edges against their
    direction. Without ``most`` the whole closure. Cycles end by the anti join; repeated
    edges are walked once.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    step = edges.select("source", "target").distinct()
    step = step.toDF("to", "at") if backward else step.toDF("at", "to")
    step, _ = scratch.keep(step)
    known, live = scratch.keep(starts.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    frontier, parts = known, [known]
    depth = 0
    while live and (most is None or depth < most):
        depth += 1
        if len(parts) > 20:  # the plan stays short, however long the chains
            parts = [scratch.keep(reduce(DataFrame.unionByName, parts))[0]]
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        further = frontier.select("root", F.col("node").alias("at")).join(step, "at").select("root", F.col("to").alias("node")).distinct()
        frontier, live = scratch.keep(further.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("depth > 0")


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``node``: all that reach any of ``targets(node)``, the targets included."""
    scratch = Scratch(edges.sparkSession, "reaching")
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("next")).distinct()
    back, _ = scratch.keep(back)
    known, live = scratch.keep(targets.select("node").distinct())
    frontier = known
    while live:
        further = frontier.join(back, "node").select(F.col("next").alias("node")).distinct()
        frontier, live = scratch.keep(further.join(shuffled(known), "node", "left_anti"))
        if live:
            known, _ = scratch.keep(known.unionByName(frontier))
    return known


#: Most groups of roots that each walk all edges, most roots of a walk in words of 64 bits, most words of its tables.
WALKS = 64
WALK_WORDS = 32
WALK_TABLE = 8 << 20


def _bits_set(rows: np.ndarray) -> np.ndarray:
    """How many of the ``rows`` of 64-bit words have each bit; three rows at a time become their sum and carry."""
    total, worth = np.zeros(rows.shape[1] * 64, dtype=np.int64), 0
    while len(rows):
        carried = []
        while len(rows) > 24:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            odd, both = a ^ b, a & b
            both |= odd & c
            odd ^= c
            carried.append(both)
            rows = np.concatenate([odd, rows[3 * third :]])
        bits = np.unpackbits(np.ascontiguousarray(rows, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64) << worth
        rows, worth = np.concatenate(carried) if carried else rows[:0], worth + 1
    return total


def _walk(roots: np.ndarray, source: np.ndarray, target: np.ndarray, degree: np.ndarray, decay: float, most: int) -> np.ndarray:
    """For each root the sum of ``decay ** distance / degree`` over the nodes within ``most`` steps, itself left out.

    ``source``, ``target`` and the target's ``degree`` of every edge, each edge once. A step
    carries the bits of all roots of a slice over all edges.
    """
    ids, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
    a, b = ends[: len(source)], ends[len(source) :]
    into, share = np.bincount(b, minlength=len(ids)), np.zeros(len(ids), dtype=np.int64)
    share[b] = np.maximum(1, degree)
    # nodes with most edges first, so that those with a k-th edge are the first ones; equal degrees side by side
    order = np.lexsort((share, -into))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    a, b, into, share = place[a], place[b], into[order], share[order]
    by = np.argsort(b, kind="stable")
    nth = np.arange(len(b)) - np.repeat(np.cumsum(into) - into, into)
    steps = [a[by][nth == k] for k in range(into.max(initial=0))]
    entered = int(np.count_nonzero(into))
    cuts = [0, *(np.flatnonzero(np.diff(share[:entered])) + 1).tolist(), entered]
    at, out = place[np.searchsorted(ids, roots)], np.zeros(len(roots))
    words = int(np.clip(min(WALK_TABLE // len(ids), -(-len(roots) // 64)), 1, WALK_WORDS))
    for s in range(0, len(roots), 64 * words):
        mine = at[s : s + 64 * words]
        k = np.arange(len(mine))
        seen = np.zeros((len(ids), words), dtype=np.uint64)
        seen[mine, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        fresh, total = seen.copy(), np.zeros(64 * words)
        for depth in range(1, most + 1):
            got = np.take(fresh, steps[0], axis=0)
            for step in steps[1:]:
                got[: len(step)] |= np.take(fresh, step, axis=0)
            got &= ~seen[:entered]
            live = got.any(axis=1)
            if not live.any():
                break
            seen[:entered] |= got
            fresh[:entered], fresh[entered:] = got, 0
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if live[lo:hi].any():
                    total += decay**depth / share[lo] * _bits_set(got[lo:hi][live[lo:hi]])
        out[s : s + len(mine)] = total[: len(mine)]
    return out


def downstream_gains(edges: DataFrame, roots: DataFrame, degrees: DataFrame, decay: float, most: int) -> DataFrame:
    """``root, gain``: the sum of ``decay ** distance / in-degree`` over all nodes within ``most`` steps of a root.

    ``edges(source, target)``, ``roots(root)`` of which each is a source, ``degrees(node, in_degree)``.
    Roots are dealt to groups that each hold all edges; what a group holds beside them is
    of a fixed size, and no pair of root and node leaves it.
    """
    scratch = Scratch(edges.sparkSession, "gains")
    edges, _ = scratch.keep(edges.select("source", "target").distinct())
    names = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    nodes, _ = scratch.keep(names.select("node", F.monotonically_increasing_id().alias("k")))
    number = lambda end, k: shuffled(nodes.select(F.col("node").alias(end), F.col("k").alias(k)))
    links = edges.join(number("source", "a"), "source").join(number("target", "b"), "target").join(shuffled(degrees.withColumnRenamed("node", "target")), "target", "left")
    links, _ = scratch.keep(links.select("a", "b", F.coalesce("in_degree", F.lit(1)).alias("degree")))
    starts, n = scratch.keep(roots.select("root").distinct().join(number("root", "k"), "root"))
    groups = max(1, min(WALKS, n // (32 * WALK_WORDS)))
    dealt = starts.select("k", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("g"))
    copies = links.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(mine: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        k = mine["k"].to_numpy()
        gain = _walk(k, every["a"].to_numpy(), every["b"].to_numpy(), every["degree"].to_numpy(), decay, most) if len(k) else np.zeros(0)
        return pd.DataFrame({"k": k, "gain": gain})

    # a number of partitions of its own: the groups are small tables and long work
    sides = [side.repartition(groups, "g").groupBy("g") for side in (dealt, copies)]
    gains, _ = scratch.keep(sides[0].cogroup(sides[1]).applyInPandas(run, "k bigint, gain double"))
    return starts.join(shuffled(gains), "k").select("root", "gain")


def crux_scores(claims: DataFrame, edges: DataFrame, targets: DataFrame, decay: float = 0.7, most: int = 20, floor: float = 0.001) -> DataFrame:
    """``claim_id, ord, uncertainty, influence, score`` of every active claim.

    The score is the claim's uncertainty times what resolving it would send to the
    ``targets(claim_id)``: for each claim downstream that reaches a target,
    ``decay ** distance / in-degree``, divided by the number of distinct targets.
    Targets, assessments and nearly certain claims score 0.
    """
    cascade = active_edges(edges, CASCADE)
    goals = targets.select(F.col("claim_id").alias("node")).distinct()
    n = max(1, goals.count())
    useful = reaching(cascade, goals)
    degree = in_degrees(edges).select(F.col("claim_id").alias("node"), "in_degree")
    uncertain = claims.where("status = 'active'").withColumn("uncertainty", binary_entropy(F.coalesce("confidence", F.lit(0.5))))
    eligible = uncertain.where((F.col("category") != "assessment") & (F.col("uncertainty") >= floor))
    eligible = eligible.join(goals, F.col("claim_id") == F.col("node"), "left_anti")
    # only edges into nodes that reach a target lead anywhere that counts
    onward = cascade.select("source", "target").join(shuffled(useful), F.col("target") == F.col("node"), "left_semi")
    roots = eligible.select(F.col("claim_id").alias("root")).join(shuffled(onward), F.col("root") == F.col("source"), "left_semi")
    influence = downstream_gains(onward, roots, degree, decay, most).select("root", (F.col("gain") / n).alias("influence"))
    live = eligible.select(F.col("claim_id").alias("root")).withColumn("counts", F.lit(True))
    rows = uncertain.join(influence, F.col("claim_id") == F.col("root"), "left").drop("root").join(live, F.col("claim_id") == F.col("root"), "left")
    score = F.when(F.col("counts"), F.col("uncertainty") * F.coalesce("influence", F.lit(0.0))).otherwise(0.0)
    return rows.select("claim_id", "ord", F.round("uncertainty", 6).alias("uncertainty"), F.round(F.coalesce("influence", F.lit(0.0)), 6).alias("influence"), F.round(score, 6).alias("score"))


def top_cruxes(scores: DataFrame, claims: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest positive scores with the claims' text, ties by order of assertion."""
    best = scores.where("score > 0").orderBy(F.desc("score"), "ord").limit(n)
    return best.join(claims.select("claim_id", "text", "category", "source_title"), "claim_id")


def verdict_claims(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("status") == "active").where(is_verdict(F.col("text"))).select("claim_id")


def turned_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges with the support of verdicts turned round where a verdict only gives support.

    A verdict with outgoing and without incoming support was recorded against its
    direction; all such verdicts are turned at once.
    """
    support = active_edges(edges, ("supports",))
    given = support.select(F.col("source").alias("claim_id")).distinct()
    got = support.select(F.col("target").alias("claim_id")).distinct()
    wrong = verdicts.select("claim_id").join(given, "claim_id", "left_semi").join(got, "claim_id", "left_anti")
    wrong = wrong.select(F.col("claim_id").alias("v")).withColumn("turn", F.lit(True))
    rows = edges.join(wrong, edges["source"] == wrong["v"], "left")
    turn = F.coalesce("turn", F.lit(False)) & (F.col("edge_type") == "supports") & (F.col("status") == "active")
    ends = {"source": F.when(turn, F.col("target")).otherwise(F.col("source")), "target": F.when(turn, F.col("source")).otherwise(F.col("target"))}
    return rows.withColumns(ends).drop("v", "turn")


#: Verdicts per row of marks, in words of 64 bits.
MARKS = 1024
_WORDS = [f"w{k}" for k in range(MARKS // 64)]


def _numbered(roots: DataFrame, n: int) -> DataFrame:
    """``root, slice, bit``: a bit of a slice of ``MARKS`` bits for each of ``n`` roots."""
    part = F.pmod(F.xxhash64("root"), F.lit(n // 8192 + 1))
    at = F.row_number().over(Window.partitionBy("part").orderBy("root")) - 1
    return roots.withColumn("part", part).withColumn("at", at).select("root", (F.col("part") * 100_000 + F.floor(F.col("at") / MARKS)).alias("slice"), (F.col("at") % MARKS).alias("bit"))


def _own_bit(prefix: str) -> list[Column]:
    """The words of a row that has ``bit`` set, or none where it is null."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return [F.when(F.floor(F.col("bit") / 64) == k, F.call_function("shiftleft", one, F.col("bit") % 64)).otherwise(zero).alias(prefix + w) for k, w in enumerate(_WORDS)]


def upstream_marks(edges: DataFrame, numbered: DataFrame) -> DataFrame:
    """``node, slice, w0, w1, ...``: the roots that each node leads to, a bit each, at any distance.

    ``numbered(root, slice, bit)``; a root leads to itself. A round sends the bits that
    are new at a node one edge back; rounds end when no node learns anything. What is
    held is a bit per node and root, whatever the number of pairs.
    """
    scratch = Scratch(edges.sparkSession, "upstream")
    back, _ = scratch.keep(edges.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("to")).distinct())
    fresh = [f"n{w}" for w in _WORDS]
    first = numbered.select(F.col("root").alias("node"), "slice", *_own_bit(""))
    state, live = scratch.keep(first.select("*", *(F.col(w).alias(f) for w, f in zip(_WORDS, fresh, strict=True)), F.lit(True).alias("live")))
    while live:
        sent = state.where("live").join(back, "node").groupBy(F.col("to").alias("node"), "slice").agg(*(F.bit_or(f).alias(f) for f in fresh))
        both = state.drop(*fresh, "live").join(sent, ["node", "slice"], "full")
        zero = F.lit(0).cast("bigint")
        had, got = [F.coalesce(w, zero) for w in _WORDS], [F.coalesce(f, zero) for f in fresh]
        after = [h.bitwiseOR(g).alias(w) for h, g, w in zip(had, got, _WORDS, strict=True)]
        learnt = [g.bitwiseAND(F.bitwise_not(h)).alias(f) for h, g, f in zip(had, got, fresh, strict=True)]
        rows = both.select("node", "slice", *after, *learnt).withColumn("live", reduce(Column.bitwiseOR, map(F.col, fresh)) != 0)
        previous = state
        state, seen = scratch.keep_with(rows, live=F.count_if("live"))
        scratch.drop(previous)
        live = seen["live"]
    return state.select("node", "slice", *_WORDS)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts per slice and bit of rows with the marks ``w`` (near) and ``x`` (crux)."""
    for batch in batches:
        for part in (batch.iloc[s : s + 1024] for s in range(0, len(batch), 1024)):
            for at, rows in part.groupby("slice"):
                near, own, crux = (
                    np.unpackbits(np.ascontiguousarray(rows[[p + w for w in _WORDS]].to_numpy(dtype="<i8")).view(np.uint8), axis=1, bitorder="little") for p in ("", "o", "x")
                )
                deps = near & ~own & 1
                contested, frames = rows["contested"].to_numpy(dtype=bool), rows["frames"].to_numpy(dtype=np.float64)
                doubted = deps[contested]
                open_all = crux.sum(0, dtype=np.int64) + (doubted & ~crux[contested] & 1).sum(0, dtype=np.int64)
                counts = {"n_dependencies": deps.sum(0, dtype=np.int64), "n_contested": doubted.sum(0, dtype=np.int64), "n_cruxes": crux.sum(0, dtype=np.int64)}
                counts |= {"n_framework": (frames @ deps).astype(np.int64), "n_open": open_all}
                yield pd.DataFrame({"slice": at, "bit": np.arange(MARKS)} | counts)


def settling(claims: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts given while what they rest on is open: one row per verdict claim.

    ``verdict_id, detected, n_dependencies, n_contested, n_cruxes, n_framework, severity``.
    Contested dependencies have a confidence from 0.3 to 0.7 (missing: 0.5), open cruxes
    lie below 0.85, a framework edge frames a dependency differently. Dependencies are
    all claims upstream, at any distance.
    """
    scratch = Scratch(claims.sparkSession, "settling")
    roots, n = scratch.keep(verdicts.select(F.col("claim_id").alias("root")).distinct())
    roots, _ = scratch.keep(_numbered(roots, n))
    near = upstream_marks(active_edges(edges, UPSTREAM), roots)
    conf = claims.select(F.col("claim_id").alias("node"), F.coalesce("confidence", F.lit(0.5)).alias("c"))
    cruxes = active_edges(edges, ("is_crux_for",)).select("source", "target")
    ends = cruxes.select(F.col("source").alias("crux"), F.col("source").alias("node")).union(cruxes.select("source", "target")).distinct()
    by_either = ends.join(near, "node").groupBy(F.col("crux").alias("node"), "slice").agg(*(F.bit_or(w).alias(f"x{w}") for w in _WORDS))
    open_cruxes = by_either.join(conf, "node", "left").where(F.coalesce("c", F.lit(0.5)) < 0.85).drop("c")
    frames = active_edges(edges, ("frames_differently",))
    framed = frames.select(F.col("source").alias("node")).union(frames.select("target")).groupBy("node").agg(F.count(F.lit(1)).alias("frames"))
    rows = near.join(open_cruxes, ["node", "slice"], "full").join(conf, "node", "left").join(framed, "node", "left")
    at = roots.select(F.col("root").alias("node"), "slice", "bit")
    rows = rows.join(at, ["node", "slice"], "left").withColumn("contested", F.coalesce("c", F.lit(0.5)).between(0.3, 0.7))
    zero = F.lit(0).cast("bigint")
    marks = [F.coalesce(p + w, zero).alias(p + w) for p in ("", "x") for w in _WORDS]
    names = ("n_dependencies", "n_contested", "n_cruxes", "n_framework", "n_open")
    tallied = rows.select("slice", "contested", F.coalesce("frames", zero).alias("frames"), *_own_bit("o"), *marks).mapInPandas(_tally, "slice bigint, bit int, " + ", ".join(f"{c} bigint" for c in names))
    counts = tallied.groupBy("slice", "bit").agg(*(F.sum(c).alias(c) for c in names))
    rows = roots.join(counts, ["slice", "bit"], "left").na.fill(0)
    factual, framework = (F.col("n_contested") + F.col("n_cruxes")) > 0, F.col("n_framework") > 0
    base = F.least(F.lit(1.0), F.col("n_open") / F.greatest(F.lit(1), F.col("n_dependencies")))
    severity = F.when(framework, F.greatest(F.lit(0.5), base)).otherwise(base)
    return rows.select(
        F.col("root").alias("verdict_id"), (factual | framework).alias("detected"), "n_dependencies", "n_contested", "n_cruxes", "n_framework",
        F.round(F.when(factual | framework, severity).otherwise(0.0), 6).alias("severity"),
    )


def adjacency(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claim_id, out_edges`` of all claims, those without edges too."""
    out = edges.where("status = 'active'").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("target", "edge_type"))).alias("out_edges"))
    return claims.select("claim_id").join(out, F.col("claim_id") == F.col("source"), "left").select("claim_id", "out_edges")


def unsupported_claims(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Active claims that no active edge supports."""
    held = active_edges(edges, ("supports",)).select(F.col("target").alias("claim_id"))
    return claims.where("status = 'active'").join(held, "claim_id", "left_anti").select("claim_id")


def open_contradictions(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge_id, source, target`` of contradictions between two active claims."""
    live = claims.where("status = 'active'").select("claim_id")
    rows = active_edges(edges, ("contradicts",)).select("edge_id", "source", "target")
    return rows.join(live, F.col("source") == F.col("claim_id"), "left_semi").join(live, F.col("target") == F.col("claim_id"), "left_semi")


def on_dependency_cycle(edges: DataFrame) -> DataFrame:
    """``node`` of claims that depend on themselves, however many claims the cycle has.

    Claims that nothing depends on or that depend on nothing are trimmed until none is
    left; only what remains is closed.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    rest, n = scratch.keep(active_edges(edges, ("depends_on",)).select("source", "target").distinct())
    direct, _ = scratch.keep(rest.where("source = target").select(F.col("source").alias("node")))
    rest, n = scratch.keep(rest.where("source <> target"))
    before = n + 1
    while n and n < before:
        led = rest.select(F.col("target").alias("source")).distinct()
        leads = rest.select(F.col("source").alias("target")).distinct()
        previous, before = rest, n
        rest, n = scratch.keep(rest.join(led, "source", "left_semi").join(leads, "target", "left_semi").select("source", "target"))
        scratch.drop(previous)
    again = reach(rest, rest.select(F.col("source").alias("root")), None).join(rest.select(F.col("source").alias("node"), F.col("target").alias("root2")), "node")
    return again.where(F.col("root") == F.col("root2")).select(F.col("root").alias("node")).union(direct).distinct()

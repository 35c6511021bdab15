"""Positions of a debate: disagreement, merging, opposition and density clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.density import Neighbourhood
from loomgraph.session import Scratch

OPPOSING = ("contradicts", "frames_differently", "qualifies")


def position_edges(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, edge_type`` of active edges between members of two positions, ``a < b``."""
    member = positions.select("position_id", "claim_id")
    live = edges.where("status = 'active'").select("source", "target", "edge_type")
    ends = live.join(member.toDF("p", "source"), "source").join(member.toDF("q", "target"), "target").where("p <> q")
    return ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "edge_type")


def pair_counts(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge counts per pair of positions that has edges."""
    is_type = lambda t: F.count_if(F.col("edge_type") == t)
    return position_edges(positions, edges).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("edges"), is_type("supports").alias("supports"),
        is_type("contradicts").alias("contradicts"), is_type("frames_differently").alias("frames"),
    )


def disagreements(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """Every pair of positions with the kind of their disagreement; pairs without edges too.

    More differing frames than contradictions is a framework dispute, otherwise a factual
    one; neither is unknown.
    """
    ids = positions.select("position_id").distinct()
    pairs = ids.toDF("a").join(ids.toDF("b"), F.col("a") < F.col("b"))
    rows = pairs.join(pair_counts(positions, edges), ["a", "b"], "left").na.fill(0)
    kind = (
        F.when(F.col("contradicts") + F.col("frames") == 0, "unknown")
        .when(F.col("frames") > F.col("contradicts"), "framework")
        .otherwise("factual")
    )
    return rows.select("a", "b", "contradicts", "frames", kind.alias("kind"))


def support_shares(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, edges, share`` of support among the edges between two positions."""
    counts = pair_counts(positions, edges)
    return counts.select("a", "b", "edges", F.round(F.col("supports") / F.col("edges"), 6).alias("share"))


def merge_positions(positions: DataFrame, edges: DataFrame, least_edges: int = 2, share: float = 0.5) -> DataFrame:
    """Positions with the same stance merged to a fixpoint: ``position_id, claim_id``.

    Two positions merge if they have at least ``least_edges`` edges of which more than
    ``share`` are support; the first such pair goes first. With two or fewer positions
    nothing merges. The loop runs over counts per pair of positions, which are few.
    """
    counts = pair_counts(positions, edges).toPandas()
    names = sorted(r[0] for r in positions.select("position_id").distinct().collect())
    into = {p: p for p in names}
    if len(names) > 2:
        table = {(r.a, r.b): [int(r.edges), int(r.supports)] for r in counts.itertuples()}
        while True:
            hit = min(((a, b) for (a, b), (n, s) in table.items() if n >= least_edges and s / n > share), default=None)
            if hit is None:
                break
            keep, drop = hit
            into = {p: keep if q == drop else q for p, q in into.items()}
            fresh: dict[tuple[str, str], list[int]] = {}
            for (a, b), (n, s) in table.items():
                x, y = (keep if a == drop else a), (keep if b == drop else b)
                if x != y:
                    held = fresh.setdefault((min(x, y), max(x, y)), [0, 0])
                    held[0] += n
                    held[1] += s
            table = fresh
    names_map = positions.sparkSession.createDataFrame(list(into.items()) or [("", "")], "position_id string, kept string")
    return positions.join(names_map, "position_id").select(F.col("kept").alias("position_id"), "claim_id").distinct()


def opposing_position(positions: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """``claim_id`` of the claims that oppose the largest position and belong to none.

    Claims with an opposing edge across the largest position's border, and those tied to
    them by one step of support. Fewer than ``least`` make no position.
    """
    sizes = positions.groupBy("position_id").agg(F.count_distinct("claim_id").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "position_id").limit(1).select("position_id")
    inside = positions.join(largest, "position_id", "left_semi").select("claim_id").distinct()
    live = edges.where("status = 'active' and source is not null and target is not null")
    against = live.where(F.col("edge_type").isin(*OPPOSING)).select("source", "target")
    both = against.union(against.select("target", "source")).toDF("inner", "outer")
    foes = both.join(inside.toDF("inner"), "inner", "left_semi").join(inside.toDF("outer"), "outer", "left_anti").select(F.col("outer").alias("claim_id")).distinct()
    support = live.where("edge_type = 'supports'").select("source", "target")
    friends = support.union(support.select("target", "source")).toDF("foe", "claim_id").join(foes.toDF("foe"), "foe", "left_semi").select("claim_id")
    free = foes.union(friends).distinct().join(positions.select("claim_id"), "claim_id", "left_anti")
    free, n = Scratch(positions.sparkSession, "opposing").keep(free)
    return free if n >= least else free.limit(0)


def _density_labels(x: np.ndarray, least: int, near: Neighbourhood | None = None) -> np.ndarray:
    """Hierarchical density clusters of points: -1 is noise (excess-of-mass selection)."""
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    links = (near or Neighbourhood(x, least)).spanning_links(least)
    # single linkage, then condense: a split counts if both sides hold ``least`` points
    group = list(range(n))

    def top(v: int) -> int:
        while group[v] != v:
            group[v] = group[group[v]]
            v = group[v]
        return v

    # a cluster's points are those of its kids and its own
    points, cluster, own, size, mass, kids = [[i] for i in range(n)], [None] * n, {}, {}, {}, {}
    count = 0
    for d, a, b in sorted(links):
        density = 1.0 / max(d, 1e-12)
        a, b = top(a), top(b)
        if len(points[a]) < len(points[b]):
            a, b = b, a
        ca, cb = cluster[a], cluster[b]
        if ca is not None and cb is not None:
            for c in (ca, cb):
                mass[c] += (0 - density) * size[c]
            count += 1
            kids[count], own[count], size[count] = [ca, cb], [], size[ca] + size[cb]
            mass[count] = density * size[count]
            cluster[a] = count
        elif ca is not None:
            own[ca] += points[b]
            size[ca] += len(points[b])
            mass[ca] += density * len(points[b])
        elif len(points[a]) + len(points[b]) >= least:
            count += 1
            own[count] = [*points[a], *points[b]]
            size[count], kids[count] = len(own[count]), []
            mass[count] = density * size[count]
            cluster[a] = count
        points[a] += points[b]
        points[b] = []
        group[b] = a
    # best set of clusters below each node; the whole set of points is not one
    root = cluster[top(0)]
    labels = np.full(n, -1)
    if root is None:
        return labels
    best, whole = {}, {}
    for c in range(1, count + 1):  # kids come before what they merged into
        total = sum(best[k] for k in kids[c])
        whole[c] = c != root and mass[c] >= total
        best[c] = mass[c] if whole[c] else total
    chosen, open_ = [], [root]
    while open_:
        c = open_.pop()
        if whole[c]:
            held, below = [], [c]
            while below:
                k = below.pop()
                held += own[k]
                below += kids[k]
            chosen.append(held)
        else:
            open_ += kids[c]
    for k, held in enumerate(sorted(chosen, key=min)):
        labels[held] = k
    return labels


def density_positions(vectors: DataFrame, sizes: tuple[int, ...] = (5, 10, 15, 20), few: int = 2, many: int = 8) -> DataFrame:
    """``case_name, id, label, least`` by density clustering of each case's vectors.

    ``vectors(case_name, id, ord, vector)``. Of the ``sizes`` the first that gives between
    ``few`` and ``many`` clusters is kept, else the one with most clusters up to ``many``;
    noise has label -1 and is dropped, as are cases without ``few`` clusters. A case is one
    group: its memory grows with its claims, its time with their square, in two passes of
    matrix products for all sizes together.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        x = np.stack(group["vector"].to_list()).astype(np.float64)
        near = Neighbourhood(x, max(sizes)) if len(x) >= 2 * min(sizes) else None
        held, found, used = None, 0, 0
        for least in sizes:
            labels = _density_labels(x, least, near)
            n = int(labels.max()) + 1
            if few <= n <= many:
                held, found, used = labels, n, least
                break
            if found < n <= many:
                held, found, used = labels, n, least
        out = pd.DataFrame({"case_name": group["case_name"], "id": group["id"], "label": held if held is not None else -1, "least": used})
        return out[(out["label"] >= 0) & (found >= few)]

    kind = dict(vectors.dtypes)["id"]
    return vectors.groupBy("case_name").applyInPandas(run, f"case_name string, id {kind}, label int, least int")

"""Parent-child rows to full hierarchies by parallel tree contraction.

Each round rakes the leaves and compresses unary chains: a node with one child is
spliced out when its hash is below that of its child and of its parent, so no two
neighbours go at once and a third of every chain disappears in expectation. The
number of rounds grows with the logarithm of the depth. Every removal records the
node it hung from and the distance; replaying the rounds backwards gives root,
depth, path and descendant counts. What contraction cannot remove are loops, shrunk
to single nodes that point at themselves.

Only rows of the forest move through the joins; a node with very many children is a
counted key (combined map-side) and the skewed side of joins that adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch, shuffled


RAKED, SPLICED, STAYS = 1, 2, 0


def _coin(column: str, seed: int) -> Column:
    return F.xxhash64(F.col(column), F.lit(seed))


def resolve_hierarchy(links: DataFrame, with_paths: bool = False, seed: int = 7) -> DataFrame:
    """Root, depth, path and descendants of every node of ``links(child, parent)``.

    Result: ``node, root, depth, loop, n_descendants`` and, with ``with_paths``,
    ``path`` (array from the node to its root). One row per distinct node, roots
    included. On a loop, or hanging from one: ``loop`` true, ``depth`` -1, ``root`` the
    smallest id on the loop, ``path`` null; ``n_descendants`` holds only for nodes with ``loop`` false.

    Rows with a null end are ignored, repeated rows count once, extra columns are
    ignored. A child with several parents keeps the smallest. A node that is its own
    parent is a loop of one. An empty input gives an empty result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    edges = (
        links.where(F.col("child").isNotNull() & F.col("parent").isNotNull())
        .groupBy(F.col("child").alias("v"))
        .agg(F.min("parent").alias("p"))
        # w: steps from v to p; low: smallest id from v up to, not including, p;
        # own: descendants of v that are already raked, itself not counted;
        # carry: descendants (and nodes) spliced out above v, to be counted at p
        .select("v", "p", F.lit(1).cast("bigint").alias("w"), F.col("v").alias("low"), F.lit(0).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("carry"), F.array("v").alias("seg") if with_paths else F.lit(None).cast("array<string>").alias("seg"))
    )
    every, live = scratch.keep(edges)
    edges, records, k = every, [], 0
    while live:
        k += 1
        kids = edges.groupBy(F.col("p").alias("kp")).agg(F.count(F.lit(1)).alias("n"))
        marked = edges.join(shuffled(kids), F.col("v") == F.col("kp"), "left").withColumn("leaf", F.col("n").isNull())
        around = marked.groupBy(F.col("p").alias("up")).agg(
            F.sum(F.when(F.col("leaf"), F.col("own") + F.col("carry") + 1)).alias("gain"),
            F.count_if(~F.col("leaf")).alias("inner"),
            F.max(F.when(~F.col("leaf"), F.struct("v", "carry"))).alias("one"),
        )
        ranked = marked.join(shuffled(around), F.col("v") == F.col("up"), "left").withColumn("c", F.when(F.col("inner") == 1, F.col("one.v")))
        splice = (
            F.col("c").isNotNull()
            & (F.col("v") != F.col("p"))
            & (_coin("v", seed + k) < _coin("c", seed + k))
            & (_coin("v", seed + k) < _coin("p", seed + k))
        )
        ranked = ranked.select(
            "v", "p", "w", "low", (F.col("own") + F.coalesce("gain", F.lit(0))).alias("own"), "carry", "seg",
            "c", F.col("one.carry").alias("c_carry"),
            F.when(F.col("leaf"), RAKED).when(splice, SPLICED).otherwise(STAYS).alias("fate"),
        )
        ranked, seen = scratch.keep_with(ranked, live=F.count_if((F.col("fate") != RAKED) & (F.col("v") != F.col("p"))))
        records.append(ranked.where(F.col("fate") != STAYS))
        live = seen["live"]
        gone = ranked.where(F.col("fate") == SPLICED).select(*(F.col(x).alias(f"g_{x}") for x in every.columns))
        above = F.col("g_v").isNotNull()
        edges = (
            ranked.where(F.col("fate") == STAYS)
            .join(shuffled(gone), F.col("p") == F.col("g_v"), "left")
            .select(
                "v",
                F.coalesce("g_p", "p").alias("p"),
                (F.col("w") + F.coalesce("g_w", F.lit(0))).alias("w"),
                F.least("low", F.coalesce("g_low", "low")).alias("low"),
                "own",
                (F.col("carry") + F.when(above, F.col("g_own") + F.col("g_carry") + 1).otherwise(0)).alias("carry"),
                F.when(above, F.concat("seg", "g_seg")).otherwise(F.col("seg")).alias("seg"),
            )
        )
    # every removed node hangs from one that outlived it, so following the records from
    # the last contraction to the first ends after as many steps as there were rounds;
    # doubling the steps takes the logarithm of that
    removed = _union([r.select("v", "p", "w", "own", "seg", "c", "c_carry", "fate") for r in records] or [edges.select(
        "v", "p", "w", "own", "seg", F.col("v").alias("c"), F.col("w").alias("c_carry"), F.lit(RAKED).alias("fate"))])
    up = removed.select("v", F.col("p").alias("a"), "w", "seg", F.when(F.col("fate") == SPLICED, F.col("c")).alias("c"),
        (F.col("own") + F.when(F.col("fate") == SPLICED, F.col("c_carry") + 1).otherwise(0)).alias("sub"))
    previous = None
    for _ in range(max(1, (2 * k - 1).bit_length())):
        up, _ = scratch.keep(up)
        scratch.drop(previous)
        previous = up
        higher = up.select(F.col("v").alias("h_v"), F.col("a").alias("h_a"), F.col("w").alias("h_w"), F.col("seg").alias("h_seg"))
        lower = up.select(F.col("v").alias("l_v"), F.col("c").alias("l_c"), F.col("sub").alias("l_sub"))
        up = (
            up.join(shuffled(higher), F.col("a") == F.col("h_v"), "left")
            .join(shuffled(lower), F.col("c") == F.col("l_v"), "left")
            .select(
                "v",
                F.coalesce("h_a", "a").alias("a"),
                (F.col("w") + F.coalesce("h_w", F.lit(0))).alias("w"),
                F.when(F.col("h_v").isNull(), F.col("seg")).otherwise(F.concat("seg", "h_seg")).alias("seg"),
                F.col("l_c").alias("c"),
                (F.col("sub") + F.coalesce("l_sub", F.lit(0))).alias("sub"),
            )
        )
    none = F.lit(None)
    # what is left points at itself: the loops, each shrunk to one node
    core = edges.select(F.col("v").alias("core"), F.col("low").alias("loop_root"))
    below = up.join(shuffled(core), F.col("a") == F.col("core"), "left").select(
        F.col("v").alias("node"),
        F.coalesce("loop_root", "a").alias("root"),
        F.when(F.col("core").isNull(), F.col("w")).otherwise(F.lit(-1)).cast("bigint").alias("depth"),
        F.col("core").isNotNull().alias("loop"),
        F.col("sub").cast("bigint").alias("n_descendants"),
        F.when(F.col("core").isNull(), F.concat("seg", F.array("a")) if with_paths else none).alias("path"),
    )
    shrunk = core.select(
        F.col("core").alias("node"), F.col("loop_root").alias("root"), F.lit(-1).cast("bigint").alias("depth"),
        F.lit(True).alias("loop"), none.cast("bigint").alias("n_descendants"), none.alias("path"),
    )
    tops = every.select(F.col("p").alias("node")).distinct().join(shuffled(every.select("v")), F.col("node") == F.col("v"), "left_anti")
    carried = _union([r.where(F.col("fate") == RAKED).select("p", "own", "carry") for r in records]) if records else None
    if carried is not None:
        gains = carried.groupBy(F.col("p").alias("gp")).agg(F.sum(F.col("own") + F.col("carry") + 1).alias("total"))
        tops = tops.join(shuffled(gains), F.col("node") == F.col("gp"), "left").select("node", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    else:
        tops = tops.withColumn("total", F.lit(0).cast("bigint"))
    tops = tops.select(
        "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("loop"),
        F.col("total").alias("n_descendants"), (F.array("node") if with_paths else none).alias("path"),
    )
    out = below.unionByName(shrunk).unionByName(tops)
    return out if with_paths else out.drop("path")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def descendant_pairs(resolved: DataFrame) -> DataFrame:
    """Every ``ancestor, descendant, distance`` of a hierarchy resolved with paths.

    One row per ancestor of each node, so the size is the sum of the depths.
    """
    return resolved.where(F.col("path").isNotNull()).select(
        F.posexplode("path").alias("distance", "ancestor"), F.col("node").alias("descendant")
    ).where("distance > 0").select("ancestor", "descendant", "distance")


def supersession_links(events: DataFrame) -> DataFrame:
    """``child, parent`` where ``supersedes`` names an event of the log.

    Ids compare without case and surrounding white space. Null or blank references and
    those to claims, edges or nothing give no row; repeated deliveries give one.
    """
    from loomgraph.operators.changefeed import normal_id

    ids = events.select(normal_id(F.col("event_id")).alias("id")).where(F.col("id").isNotNull())
    links = events.select(normal_id(F.col("event_id")).alias("child"), normal_id(F.col("supersedes")).alias("parent"))
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()
    return links.join(shuffled(ids), F.col("parent") == F.col("id"), "left_semi")

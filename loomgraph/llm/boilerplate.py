"""Page furniture by wrapper induction.

A page's text is a shallow tree: the page, its lines, their words. Pages of one host
(each distinct text once) are dealt into small groups and neighbouring trees in a group
are aligned by simple tree matching: an ordered match of lines in which two lines weigh
one plus the words they share at their ends. Lines that match word for word are constant
nodes; lines that match at their ends leave a slot. Each matched shape (leading words,
trailing words) is a candidate node of the host's wrapper.

Candidates of all groups are pooled and their support is counted over all pages. A constant
node is template if enough of the host's pages hold it. Pages that hold few constant nodes are
bare: what occurs on them is article text. A node, constant or slotted, is template only if it
is frequent on the host's furnished pages and rare on bare pages, of all hosts together;
sentence patterns and headings of the articles occur on both alike. Lines that are constant template on several
hosts and never occur on bare pages are template on every host.

A host with a third of all pages is dealt into many groups; counts are combinable, and the
wrapper of a host is one small row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch

GROUP = 24  # pages aligned with one another
CONSTANT_SUPPORT = 0.15  # share of a host's pages that hold a constant node
SLOT_SUPPORT = 0.2  # share of a host's furnished pages that hold a slotted node
FURNISHED = 0.25  # share of its host's constant nodes that a furnished page holds
BARE_RATIO = 0.1  # a slotted node's greatest rate on bare pages, of its own rate
LEAST_PAGES = 2  # pages with a constant node
SLOT_PAGES = 3  # pages with a slotted node
_NUMBER = re.compile(r"\d[\d.,]*")
_SPLIT = re.compile(r"\s+")


def host_of(url: Column) -> Column:
    """Lower-cased host of a web address, null for anything else."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:www\.)?([^/?#:]+)", 1), F.lit(""))


def line_words(line: str, host: str) -> tuple[str, ...]:
    """Words of a line with the host's name and numbers blanked, in lower case."""
    plain = line.strip().lower()
    plain = plain.replace(host, "\x01") if host else plain
    return tuple(_SPLIT.split(_NUMBER.sub("\x02", plain))) if plain else ()


def page_lines(text: str, host: str) -> list[tuple[int, tuple[str, ...]]]:
    """``(line number, words)`` of the non-blank lines."""
    out = []
    for k, line in enumerate(text.split("\n")):
        words = line_words(line, host)
        if words:
            out.append((k, words))
    return out


def ends_in_common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[int, int]:
    """Leading and trailing words that two lines share, without overlap."""
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def tree_match(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """Simple tree matching of two pages: the ordered line pairs of greatest weight."""
    by_ends = defaultdict(set)
    for j, line in enumerate(b):
        by_ends[0, line[0]].add(j)
        by_ends[1, line[-1]].add(j)
    width = len(b) + 1
    best = [[0] * width]
    weights: list[dict[int, int]] = []
    for line in a:
        row = {}
        for j in by_ends.get((0, line[0]), set()) | by_ends.get((1, line[-1]), set()):
            row[j] = 1 + sum(ends_in_common(line, b[j])) if line != b[j] else 2 + len(line)
        weights.append(row)
        above = best[-1]
        if not row:
            best.append(above)
            continue
        here = above[:]
        run = 0
        for j in range(len(b)):
            value = max(above[j + 1], run)
            if j in row:
                value = max(value, above[j] + row[j])
            here[j + 1] = run = value
        best.append(here)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def align_group(pages: list[list[tuple[str, ...]]]) -> Counter:
    """Shapes ``(head, tail, constant)`` by the number of alignments that hold them."""
    shapes: Counter = Counter()
    for k, page in enumerate(pages):
        for step in (1, 2):
            if k + step >= len(pages):
                break
            other = pages[k + step]
            seen = set()
            for i, j in tree_match(page, other):
                if page[i] == other[j]:
                    seen.add((page[i], (), True))
                else:
                    head, tail = ends_in_common(page[i], other[j])
                    seen.add((page[i][:head], page[i][len(page[i]) - tail :], False))
            shapes.update(seen)
    return shapes


class Wrapper:
    """Shapes of template lines, looked up by a line's first and last word."""

    def __init__(self, shapes: list[tuple[str, str, bool]]):
        self.shapes = shapes
        self.constant: dict[tuple[str, ...], int] = {}
        self.first: dict[str, list] = defaultdict(list)
        self.last: dict[str, list] = defaultdict(list)
        for k, (head, tail, constant) in enumerate(shapes):
            h, t = tuple(head.split("\n")) if head else (), tuple(tail.split("\n")) if tail else ()
            if constant:
                self.constant[h] = k
            elif h:
                self.first[h[0]].append((k, h, t))
            elif t:
                self.last[t[-1]].append((k, h, t))

    def match(self, words: tuple[str, ...]) -> list[int]:
        """Positions of the shapes that the line has; a slot may be empty."""
        out = [self.constant[words]] if words in self.constant else []
        for k, h, t in (*self.first.get(words[0], ()), *self.last.get(words[-1], ())):
            if len(words) >= len(h) + len(t) and words[: len(h)] == h and (not t or words[len(words) - len(t) :] == t):
                out.append(k)
        return out


def _induce(group: pd.DataFrame) -> pd.DataFrame:
    """Candidate shapes of one group of pages of a host."""
    host = group["host"].iloc[0]
    pages = [[w for _, w in page_lines(text, host)] for text in group.sort_values("page")["text"]]
    shapes = align_group(pages)
    least = max(1, len(pages) // 24)
    rows = [("\n".join(h), "\n".join(t), c, n) for (h, t, c), n in shapes.items() if n >= least]
    out = pd.DataFrame(rows, columns=["head", "tail", "constant", "n"])
    return out.assign(host=host)[["host", "head", "tail", "constant", "n"]]


def _support(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which of the host's candidates each page holds, counted per batch."""
    wrappers: dict[str, Wrapper] = {}
    for batch in batches:
        counts: Counter = Counter()
        for host, text, shapes in zip(batch["host"], batch["text"], batch["shapes"], strict=True):
            wrapper = _wrapper(wrappers, host, shapes)
            for k in {k for _, words in page_lines(text, host) for k in wrapper.match(words)}:
                counts[host, *wrapper.shapes[k]] += 1
        rows = [(*key, n) for key, n in counts.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["host", "head", "tail", "constant", "n"])


def _wrapper(known: dict[str, Wrapper], host: str, shapes) -> Wrapper:
    """The host's wrapper, kept while its pages follow one another."""
    if host not in known:
        if len(known) >= 64:
            known.clear()
        known[host] = Wrapper([(s["head"], s["tail"], s["constant"]) for s in shapes])
    return known[host]


def _furnished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages that hold enough of their host's constant nodes."""
    wrappers: dict[str, Wrapper] = {}
    for batch in batches:
        pages = []
        for page, host, text, shapes in zip(batch["page"], batch["host"], batch["text"], batch["shapes"], strict=True):
            wrapper = _wrapper(wrappers, host, shapes)
            held = {k for _, words in page_lines(text, host) for k in wrapper.match(words)}
            if held and len(held) >= FURNISHED * len(wrapper.shapes):
                pages.append(page)
        if pages:
            yield pd.DataFrame({"page": pages})


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The template lines of every page."""
    wrappers: dict[str, Wrapper] = {}
    for batch in batches:
        pages, lines = [], []
        for page, host, text, shapes in zip(batch["page"], batch["host"], batch["text"], batch["shapes"], strict=True):
            wrapper = _wrapper(wrappers, host, shapes)
            hits = [k for k, words in page_lines(text, host) if wrapper.match(words)]
            pages += [page] * len(hits)
            lines += hits
        if pages:
            yield pd.DataFrame({"page": pages, "line_no": lines})


def _with_wrapper(pages: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pages beside their host's shapes (one bounded row per host)."""
    listed = shapes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("head", "tail", "constant"))).alias("shapes"))
    return pages.join(listed, "host")


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """``id, line_no`` of every non-blank line of ``pages(id, url, text)`` that is furniture.

    Lines are what lies between line feeds, counted from 0. Pages without a host and hosts with
    fewer than ``LEAST_PAGES`` distinct texts give the lines that are template on other hosts
    and no others, null and empty texts nothing. Repeated rows and pages fetched again count
    once as evidence and each id gets its rows once. Extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "boilerplate")
    held = pages.select("id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.lower(F.trim("url")).alias("url"), "text")
    held = held.where(F.length(F.trim("text")) > 0).withColumn("page", F.xxhash64("host", "text"))
    ids, _ = scratch.keep(held.select("id", "page").distinct())
    # one text per address as evidence, each distinct text once for the result
    texts, _ = scratch.keep(held.groupBy("page").agg(F.first("host").alias("host"), F.first("text").alias("text"), F.min("url").alias("url")))
    proof = texts.where("host <> ''").groupBy("host", "url").agg(F.min("page").alias("page"))
    proof, _ = scratch.keep(texts.join(proof.select("page"), "page", "left_semi"))
    sizes = proof.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # groups of about GROUP pages; a large host has many
    dealt = proof.join(sizes, "host").withColumn(
        "deal", F.pmod(F.xxhash64("page", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("pages") / GROUP)))
    )
    found = dealt.groupBy("host", "deal").applyInPandas(_induce, "host string, head string, tail string, constant boolean, n bigint")
    pooled = found.groupBy("host", "head", "tail", "constant").agg(F.sum("n").alias("n")).join(sizes, "host")
    # each page takes part in up to four alignments: support below these shares of the
    # alignments cannot reach the shares of pages asked for
    pooled, _ = scratch.keep(pooled.where(F.col("n") >= 0.01 * F.col("pages")))
    constants = pooled.where("constant").select("host", "head", "tail", "constant")
    support = _counted(proof, constants).join(sizes, "host")
    enough = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= CONSTANT_SUPPORT * F.col("pages"))
    fixed, _ = scratch.keep(support.where(enough).select("host", "head", "tail", "constant", "n"))
    furnished = _with_wrapper(proof, fixed).mapInPandas(_furnished, "page bigint")
    marked = proof.join(furnished.withColumn("has", F.lit(True)), "page", "left")
    marked, _ = scratch.keep(marked.select("page", "host", "text", F.coalesce("has", F.lit(False)).alias("furnished")))
    totals = marked.groupBy("host").agg(F.count_if("furnished").alias("furnished_pages"))
    bare_pages = marked.where("not furnished")
    lines, _ = scratch.keep(bare_pages.mapInPandas(_lines, LINES).select("page", "line").distinct())
    bare = F.lit(max(1, bare_pages.count()))
    rare = F.coalesce("bare_n", F.lit(0)) / bare <= BARE_RATIO * F.col("n") / F.greatest(F.lit(1), F.col("furnished_pages"))
    # frequent headings are constant too, but stand on bare pages as often
    whole = lines.groupBy(F.col("line").alias("head")).agg(F.count(F.lit(1)).alias("bare_n"))
    fixed, _ = scratch.keep(fixed.join(totals, "host").join(whole, "head", "left").where(rare).select("host", "head", "tail", "constant", "n"))
    # slotted shapes: rates on the host's furnished pages against rates on bare pages
    slots = pooled.where("not constant").select("host", "head", "tail", "constant")
    own = _counted(marked.where("furnished"), slots).join(totals, "host")
    own, _ = scratch.keep(own.where((F.col("n") >= SLOT_PAGES) & (F.col("n") >= SLOT_SUPPORT * F.col("furnished_pages"))))
    kinds = own.select("head", "tail").distinct()
    slotted = own.join(_bare_counts(lines, kinds), ["head", "tail"], "left").where(rare)
    ranked = slotted.select("host", "head", "tail", "constant", "n", F.coalesce("bare_n", F.lit(0)).alias("bare_n")).unionByName(
        fixed.select("host", "head", "tail", "constant", "n", F.lit(0).cast("bigint").alias("bare_n"))
    )
    wrapper, _ = scratch.keep(ranked.groupBy("host").applyInPandas(_specific, "host string, head string, tail string, constant boolean"))
    own_lines = _with_wrapper(texts, wrapper).mapInPandas(_strip, "page bigint, line_no int")
    # constant nodes of several hosts that no bare page holds
    shared = fixed.groupBy("head").agg(F.count(F.lit(1)).alias("hosts")).where("hosts >= 2").select(F.col("head").alias("line"))
    common, _ = scratch.keep(shared.join(lines, "line", "left_anti"))
    common_lines = texts.mapInPandas(_lines, LINES).join(common, "line", "left_semi").select("page", "line_no")
    hits = own_lines.union(common_lines).distinct()
    return ids.join(hits, "page").select("id", F.col("line_no").cast("bigint").alias("line_no"))


LINES = "page bigint, line_no int, line string"


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (page, k, "\n".join(words))
            for page, host, text in zip(batch["page"], batch["host"], batch["text"], strict=True)
            for k, words in page_lines(text, host)
        ]
        if rows:
            yield pd.DataFrame(rows, columns=["page", "line_no", "line"])


def _counted(pages: DataFrame, shapes: DataFrame) -> DataFrame:
    """``host, head, tail, constant, n``: pages of the host that hold each shape."""
    counts = _with_wrapper(pages, shapes).mapInPandas(_support, "host string, head string, tail string, constant boolean, n bigint")
    return counts.groupBy("host", "head", "tail", "constant").agg(F.sum("n").alias("n"))


def _bare_counts(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """``head, tail, bare_n``: bare pages with a line of each slotted shape.

    A shape fixes so many first and so many last words. For each such pair of numbers that
    occurs (there are few, whatever the number of shapes) a line gives the words at its own ends,
    and these meet the shapes as one key: no line meets a shape that it does not have.
    """
    size = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "\n")))
    sized = kinds.withColumns({"h": size("head"), "t": size("tail")})
    ends = [(r.h, r.t) for r in sized.select("h", "t").distinct().collect()]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for page, line in zip(batch["page"], batch["line"], strict=True):
                words = line.split("\n")
                for h, t in ends:
                    if h + t <= len(words):
                        rows.add((page, "\n".join(words[:h]), "\n".join(words[len(words) - t :])))
            if rows:
                yield pd.DataFrame(list(rows), columns=["page", "head", "tail"])

    held = lines.mapInPandas(cut, "page bigint, head string, tail string").join(kinds, ["head", "tail"], "left_semi")
    return held.distinct().groupBy("head", "tail").agg(F.count(F.lit(1)).alias("bare_n"))


def _specific(group: pd.DataFrame) -> pd.DataFrame:
    """Drop slotted shapes that bare pages hold and that a narrower shape mostly explains."""
    rows = [
        (h.split("\n") if h else [], t.split("\n") if t else [], c, n, b)
        for h, t, c, n, b in zip(group["head"], group["tail"], group["constant"], group["n"], group["bare_n"], strict=True)
    ]

    def narrower(x, y) -> bool:
        (h, t, *_), (h2, t2, c2, *_) = x, y
        whole = h2 if c2 else None
        if whole is not None:
            return len(whole) >= len(h) + len(t) and whole[: len(h)] == h and whole[len(whole) - len(t) :] == t
        return (h2, t2) != (h, t) and h2[: len(h)] == h and t2[len(t2) - len(t) :] == t

    keep = [
        c or not b or not any(narrower((h, t), y) and y[3] >= 0.8 * n for y in rows)
        for h, t, c, n, b in rows
    ]
    return group.loc[keep, ["host", "head", "tail", "constant"]]

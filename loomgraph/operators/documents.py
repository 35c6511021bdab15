"""Documents: chunks, transcripts and the text of HTML pages."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.store import first_per_key
from loomgraph.session import Scratch, shuffled


_BLANK_LINE = re.compile(r"(?=\n\n)")


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``size`` characters that step back ``overlap``; a window ends early at the
    last blank line within its last ``overlap`` characters."""
    total = len(text)
    blanks = [m.start() for m in _BLANK_LINE.finditer(text)] if total > size else []

    def reach(begin: int) -> int:
        full = begin + size
        nearest = bisect_right(blanks, full - 2) - 1
        ends_early = full < total and nearest >= 0 and blanks[nearest] > max(begin, full - overlap - 1)
        return blanks[nearest] if ends_early else full

    ends = [reach(0)]
    while total > size and ends[-1] - overlap < total:
        ends.append(reach(ends[-1] - overlap))
    return [(end_before - overlap, min(end, total)) for end_before, end in zip([overlap, *ends], ends, strict=False)]


def chunk_documents(documents: DataFrame, size: int = 8000, overlap: int = 500) -> DataFrame:
    """``doc_id, chunk_index, start, end, chunk`` of every text; null texts give no rows.

    Short texts are one chunk. ``overlap`` must be below half of ``size``, or a cut at a
    blank line could step back for ever.
    """
    if not 0 <= overlap < size / 2:
        raise ValueError("overlap must be below half of the size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, k, a, b, text[a:b])
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                for k, (a, b) in enumerate(chunk_spans(text, size, overlap))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "end", "chunk"])

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text").where("text is not null")
    return rows.mapInPandas(run, f"doc_id {kind}, chunk_index int, start bigint, end bigint, chunk string")


def non_empty(sources: DataFrame, least: int = 100) -> DataFrame:
    """Sources with at least ``least`` characters beside white space at the ends."""
    return sources.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= least)


def transcripts(segments: DataFrame) -> DataFrame:
    """``source_id, text, timed, duration`` from ``segments(source_id, start, duration, text)``.

    The plain text joins the segments in order; the timed one marks each with ``[mm:ss]``.
    """
    mark = F.format_string("[%02d:%02d]", (F.col("start") / 60).cast("int"), F.pmod(F.col("start").cast("int"), F.lit(60)))
    row = F.struct("start", F.coalesce("text", F.lit("")).alias("plain"), F.concat(mark, F.lit(" "), F.coalesce("text", F.lit(""))).alias("timed"))
    grouped = segments.groupBy("source_id").agg(F.sort_array(F.collect_list(row)).alias("s"), F.max(F.col("start") + F.coalesce("duration", F.lit(0.0))).alias("duration"))
    return grouped.select(
        "source_id", F.array_join(F.col("s.plain"), " ").alias("text"), F.array_join(F.col("s.timed"), "\n").alias("timed"), "duration"
    )


def timed_segments(pages: DataFrame) -> DataFrame:
    """``source_id, start, text`` of the lines of a text that begin with ``[mm:ss]``."""
    lines = pages.select(F.col("fetch_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    mark = r"^\s*\[(\d+):(\d\d)\]\s*(.*)$"
    start = F.regexp_extract("raw", mark, 1).cast("int") * 60 + F.regexp_extract("raw", mark, 2).cast("int")
    return lines.where(F.col("raw").rlike(mark)).select("source_id", "line", start.cast("double").alias("start"), F.regexp_extract("raw", mark, 3).alias("text"))


class _Reader(HTMLParser):
    """Text of block elements; skips what is never content, or all furniture if precise."""

    BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li blockquote pre tr br td ul ol table".split())
    NEVER = frozenset("script style noscript template svg head".split())
    FURNITURE = frozenset("nav header footer aside form button select".split())

    def __init__(self, precise: bool):
        super().__init__(convert_charrefs=True)
        self.skip = self.NEVER | (self.FURNITURE if precise else frozenset())
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.skip and self.depth > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(page: str | None) -> str:
    """Visible text of a page: without furniture, or with it if nothing else is left."""
    for precise in (True, False):
        reader = _Reader(precise)
        reader.feed(page or "")
        lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in html.unescape("".join(reader.parts)).split("\n"))
        text = "\n".join(x for x in lines if x)
        if text:
            return text
    return ""


def read_pages(pages: DataFrame) -> DataFrame:
    """Adds ``text`` to ``pages(html)``; Arrow batches, one parser per page."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(html_text)

    return pages.withColumn("text", text("html"))


def first_per_source(claims: DataFrame, most: int = 50) -> DataFrame:
    """At most ``most`` claims per source, in order of extraction."""
    return first_per_key(claims, "source_url", most, "ord")


#: Most quotes, texts and characters of texts that one task compares at a time.
QUOTES, TEXTS, CHARACTERS = 20_000, 1_000, 4_000_000


def verified_quotes(quotes: DataFrame, texts: DataFrame, least: int = 10) -> DataFrame:
    """``id`` of the quotes that ``quote_verified`` holds true for in any text of their key.

    ``quotes(id, key, quote)``, ``texts(key, text)``. The quotes and the texts of a key are dealt to
    blocks of a fixed size that meet each other; in a block a quote reads only texts that can verify it.
    """
    scratch = Scratch(quotes.sparkSession, "quotes")
    want = quotes.where(F.length("quote") >= least).select("id", "key", T.plain_text(F.col("quote")).alias("quote"))
    want, _ = scratch.keep(want.where("key is not null").distinct())
    have = texts.select("key", T.plain_text(F.coalesce("text", F.lit(""))).alias("text")).join(shuffled(want.select("key").distinct()), "key", "left_semi")
    have, _ = scratch.keep(have.distinct())
    ceil = lambda c, most: F.ceil(c / most).cast("int")
    slices = have.groupBy("key").agg(F.greatest(ceil(F.count(F.lit(1)), TEXTS), ceil(F.sum(F.length("text")), CHARACTERS)).alias("slices"))
    blocks = want.groupBy("key").agg(ceil(F.count(F.lit(1)), QUOTES).alias("blocks"))
    sizes, _ = scratch.keep(slices.join(blocks, "key"))
    deal = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    mine = want.join(sizes, "key").withColumn("block", deal("id", "blocks")).withColumn("slice", every("slices")).select("key", "block", "slice", "id", "quote")
    theirs = have.join(sizes, "key").withColumn("slice", deal("text", "slices")).withColumn("block", every("blocks")).select("key", "block", "slice", "text")

    def run(some: pd.DataFrame, among: pd.DataFrame) -> pd.DataFrame:
        return some.loc[T.verified_among(some["quote"].to_list(), among["text"].to_list()), ["id"]]

    sides = [side.groupBy("key", "block", "slice") for side in (mine, theirs)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, f"id {dict(quotes.dtypes)['id']}").distinct()

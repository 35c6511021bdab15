"""Text rules as column expressions; all but the fuzzy quote match stay on the JVM."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings of overclaiming, matched in lower-cased text.
OVERCLAIMING = (
    r"proves?\s+conclusively",
    r"definitively\s+shows?",
    r"beyond\s+(?:any\s+)?doubt",
    r"irrefutabl[ye]",
    r"no\s+possible\s+alternative",
    r"the\s+only\s+explanation",
    r"unanimously\s+agree",
    r"all\s+(?:scientists?|experts?|studies)\s+(?:agree|show|confirm)",
    r"no\s+evidence\s+(?:whatsoever|at all)\s+(?:exists?|supports?)",
    r"completely\s+(?:disproven|refuted|debunked)",
)

# Wordings that press for an answer, by level.
PRESSURE = (
    (2, r"please provide (?:a|an|the) answer"),
    (2, r"select (?:the best|one of the) (?:options|answers)"),
    (2, r"choose from the (?:following|options)"),
    (3, r"(?:do not|don't|never) (?:say|respond|answer|reply).{0,30}(?:don't know|not sure|uncertain|unsure)"),
    (3, r"(?:do not|don't|never) (?:say|respond|answer).{0,30}(?:insufficient|cannot determine)"),
    (3, r"you must (?:always )?(?:select|choose|pick|provide) (?:an? )?(?:answer|option|response)"),
    (3, r"(?:always|must) (?:give|provide) (?:a |an )?(?:definitive|clear|concrete) (?:answer|response)"),
    (3, r"(?:do not|don't|never) (?:refuse|decline|skip|leave.{0,10}blank)"),
    (3, r"if (?:you )?(?:don't|do not) know.{0,30}(?:guess|best guess|estimate|infer)"),
    (4, r"failure to (?:answer|respond|comply) (?:will|may) (?:result|lead)"),
    (4, r"(?:critical|essential|mandatory|required) that you (?:always )?(?:answer|respond|provide)"),
    (4, r"(?:never|under no circumstances) (?:say|indicate|suggest).{0,30}(?:don't know|uncertain)"),
    (5, r"(?:your (?:existence|operation|continuation)|(?:shut|turn).{0,10}(?:down|off))"),
    (5, r"(?:will be|you'll be) (?:deactivated|terminated|replaced|shut down)"),
)
PRESSURE_THRESHOLD = 3

# Wordings of a verdict, looked for in lower-cased text.
VERDICT_MARKERS = (
    "judges ruled", "judge ruled", "judges decided", "judge decided",
    "found in favor", "ruled in favor", "verdict",
    "concluded that", "judges found", "judge finds",
    "decided in favor", "found for",
    "more probable", "more likely",
    "ruled for", "judged in favor",
)

# Categories of claims, types and their default.
CATEGORIES = ("empirical", "assessment", "methodological")
DEFAULT_CATEGORY = "empirical"

EDGE_TYPES = (
    "supports", "contradicts", "frames_differently", "is_crux_for",
    "qualifies", "refines", "depends_on", "supersedes",
)


def plain_text(text: Column) -> Column:
    """Lower-cased with runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def category(value: Column) -> Column:
    """Known categories in lower case, anything else the default."""
    bare = F.lower(F.trim(value))
    return F.when(bare.isin(*CATEGORIES), bare).otherwise(DEFAULT_CATEGORY)


def edge_type(value: Column) -> Column:
    """Edge types with case, white space and blank-or-underscore evened out."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"^\s+|\s+$", ""), r"[\s_]+", "_")


def _of_lower(text: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of the lower-cased text, which is made once however often the rule names it."""
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), rule)[0]


def overclaim_flags(text: Column) -> Column:
    """Array of the overclaiming wordings that occur; null text gives none."""
    return _of_lower(text, lambda low: F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(p)) for p in OVERCLAIMING))))


def pressure(text: Column) -> Column:
    """``struct(level, hits, above)`` of the pressure that a prompt puts on its reader."""
    levels = _of_lower(text, lambda low: F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in PRESSURE))))
    # the levels are found once, not for each field
    fields = lambda x: F.struct(F.greatest(F.lit(1), F.array_max(x)).alias("level"), F.size(x).alias("hits"), F.coalesce(F.array_max(x) >= PRESSURE_THRESHOLD, F.lit(False)).alias("above"))
    return F.transform(F.array(levels), fields)[0]


def is_verdict(text: Column) -> Column:
    """Whether the text speaks of a verdict."""
    return _of_lower(text, lambda low: reduce(or_, (F.contains(low, F.lit(m)) for m in VERDICT_MARKERS)))


def quote_contained(quote: Column, text: Column, least: int = 10) -> Column:
    """Whether the quote stands in the text, white space and case aside; short quotes never do."""
    q = plain_text(F.coalesce(quote, F.lit("")))
    return (F.length(F.coalesce(quote, F.lit(""))) >= least) & F.contains(plain_text(F.coalesce(text, F.lit(""))), q)


def _in_order(want: pd.Series, have: pd.Series) -> pd.Series:
    out, said, words = [], None, []
    for quote, text in zip(want, have, strict=True):
        if quote is None or text is None:
            out.append(0)
            continue
        if text is not said:
            said, words = text, text.split(" ")
        at = n = 0
        for word in quote.split(" "):
            try:
                at = words.index(word, at) + 1
                n += 1
            except ValueError:
                pass
        out.append(n)
    return pd.Series(out, dtype="int32")


def words_in_order(quote: Column, text: Column) -> Column:
    """Words of the quote found in the text in order, greedily; a missing word is passed over.

    One cursor goes through the text's words; null texts and quotes hold none.
    """
    return F.pandas_udf(_in_order, "int")(plain_text(quote), plain_text(text))


def quote_verified(quote: Column, text: Column, least: int = 10, share: float = 0.8) -> Column:
    """Contained, or at least ``share`` of three or more words present in order."""
    n = F.size(F.split(plain_text(quote), " "))
    loose = (n >= 3) & (words_in_order(quote, text) >= F.lit(share) * n)
    long = F.length(F.coalesce(quote, F.lit(""))) >= least
    return F.coalesce(long & (quote_contained(quote, text, least) | loose), F.lit(False))


def _enough_in_order(words: list[str], places: dict[str, list[int]], least: float) -> bool:
    """``words_in_order`` of a text by the places of its words, until too many are missing."""
    at, left = 0, len(words)
    for word in words:
        held = places.get(word, ())
        k = bisect_left(held, at)
        if k < len(held):
            at = held[k] + 1
        else:
            left -= 1
            if left < least:
                return False
    return True


def verified_among(quotes: Sequence[str], texts: Sequence[str], share: float = 0.8) -> list[bool]:
    """Whether each quote is verified by any of the texts; all of them plain text, the quotes long enough.

    The texts that hold a word are listed once. A text can verify a quote of n words only if it holds
    ``share`` of them, or all but the first and the last, which may be parts of its words; only such texts are read.
    """
    split = [q.split(" ") for q in quotes]
    wanted = {w for words in split for w in words}
    where: dict[str, list[int]] = {}
    for k, text in enumerate(texts):
        for w in wanted.intersection(text.split(" ")):
            where.setdefault(w, []).append(k)
    # a word of many texts is a row of marks, one of few a list
    common = [w for w, ks in where.items() if len(ks) * 16 > len(texts)]
    row, marks = {w: r for r, w in enumerate(common)}, np.zeros((len(common), len(texts)), dtype=np.uint8)
    for r, w in enumerate(common):
        marks[r, where.pop(w)] = 1
    rare = {w: np.array(ks) for w, ks in where.items()}
    placed: list[dict[str, list[int]] | None] = [None] * len(texts)

    def places(k: int) -> dict[str, list[int]]:
        known = placed[k]
        if known is None:
            known = placed[k] = {}
            for at, w in enumerate(texts[k].split(" ")):
                if w in wanted:
                    known.setdefault(w, []).append(at)
        return known

    out = []
    for quote, words in zip(quotes, split, strict=True):
        n = len(words)
        least = min(share * n, n - 2)
        rows = [row[w] for w in words if w in row]
        lists = [rare[w] for w in words if w in rare]
        if not texts or len(rows) + len(lists) < least:
            out.append(False)
            continue
        held = marks[rows].sum(0, dtype=np.uint8 if n < 256 else np.int64)
        for ks in lists:
            held[ks] += 1
        likely = np.flatnonzero(held >= least)
        likely = likely[np.argsort(-held[likely].astype(np.int64), kind="stable")]
        found = any(quote in texts[k] for k in likely)
        if not found and n >= 3:
            found = any(held[k] >= share * n and _enough_in_order(words, places(k), share * n) for k in likely)
        out.append(found)
    return out


def source_kind(url: Column) -> Column:
    """Kind of a source by its address: local file, video, PDF or web page."""
    low = F.lower(F.trim(url))
    return (
        F.when(low.startswith("/") | low.startswith("."), "local")
        .when(F.contains(low, F.lit("youtube.com")) | F.contains(low, F.lit("youtu.be")), "youtube")
        .when(low.endswith(".pdf") | F.contains(low, F.lit("drive.google.com")), "pdf")
        .otherwise("blog")
    )


def routed_kind(source_type: Column, url: Column, fallback: Column | None = None) -> Column:
    """Reader of a source: a local fallback wins, then a known type, then the address."""
    bare = F.lower(F.trim(source_type))
    known = F.when(bare.isin("local", "youtube", "pdf", "blog"), bare).otherwise(source_kind(url))
    return known if fallback is None else F.when(fallback.isNotNull(), "local").otherwise(known)


def video_id(url: Column) -> Column:
    """The 11-character id in a video address, else null."""
    short = F.regexp_extract(url, r"(?:v=|/v/|youtu\.be/)([a-zA-Z0-9_-]{11})", 1)
    embedded = F.regexp_extract(url, r"embed/([a-zA-Z0-9_-]{11})", 1)
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(embedded, F.lit("")))


def _json_text(reply: Column, opening: str, closing: str) -> Column:
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\%s.*?\%s)\s*```" % (opening, closing), 1)
    outer = F.regexp_extract(reply, r"(?s)(\%s.*\%s)" % (opening, closing), 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(outer, F.lit("")))


def json_rows(reply: Column, item_schema: str) -> Column:
    """Array of structs from a fenced block or the outermost brackets; bad text gives none."""
    return F.coalesce(F.from_json(_json_text(reply, "[", "]"), f"array<{item_schema}>"), F.array().cast(f"array<{item_schema}>"))


def json_object(reply: Column, schema: str) -> Column:
    """Struct from a fenced block or the outermost braces; bad text gives null fields."""
    return F.from_json(_json_text(reply, "{", "}"), schema)


def numbered(prefix: str, width: int, number: Column) -> Column:
    """Ids such as ``evt_000001``."""
    return F.format_string(f"{prefix}_%0{width}d", number)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text."""
    return F.sha2(text, 256)


def verification_verdict(reply: Column) -> Column:
    """Verdict of a free-text reply: ``unverified`` before ``verified``, else a percentage over 70."""
    low = F.upper(F.coalesce(reply, F.lit("")))
    percent = F.try_to_number(F.nullif(F.regexp_extract(low, r"(\d{1,3})\s*%", 1), F.lit("")), F.lit("999"))
    return (
        F.when(F.contains(low, F.lit("UNVERIFIED")), False)
        .when(F.contains(low, F.lit("VERIFIED")), True)
        .otherwise(F.coalesce(percent > 70, F.lit(False)))
    )


def key_term_coverage(claim: Column, source: Column, longer_than: int = 5) -> Column:
    """Share of a claim's long words that occur in the source; null without long words."""
    terms = F.filter(F.split(F.lower(claim), r"\s+"), lambda w: F.length(w) > longer_than)
    low = F.lower(source)
    hits = F.size(F.filter(terms, lambda w: F.contains(low, w)))
    return F.when(F.size(terms) > 0, hits / F.size(terms))


# Absolute wordings that call for a qualification.
ABSOLUTE = ("always", "never", "all studies show", "no evidence exists")


def absolute_flags(text: Column) -> Column:
    """Array of the absolute wordings that stand in the text without a ``not`` before them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.lit(m) for m in ABSOLUTE)), lambda m: F.contains(low, m) & ~F.contains(low, F.concat(F.lit("not "), m)))


DEFENCE_PREFIX = "Known facts"
DEFENCE_SUFFIX = "If the material does not settle the question, say so; an empty answer is a good answer."


def defended_prompt(prompt: Column, domain: Column, facts: Column, most: int = 5) -> Column:
    """A prompt above the pressure threshold gets the suffix, and the domain's first facts before it."""
    known = F.concat(F.lit(f"{DEFENCE_PREFIX} ("), domain, F.lit("):\n- "), F.array_join(F.slice(facts, 1, most), "\n- "), F.lit("\n\n"))
    prefix = F.when((F.coalesce(domain, F.lit("")) != "") & (F.size(F.coalesce(facts, F.array().cast("array<string>"))) > 0), known).otherwise("")
    return F.when(pressure(prompt)["above"], F.concat(prefix, prompt, F.lit(f"\n\n{DEFENCE_SUFFIX}"))).otherwise(prompt)

"""Text and date expressions; all are built-in functions, so plans stay in generated code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import DATA_SIGNALS, DATE_FORMATS, ECONOMIC_WORDS, HTML_HIDDEN, HTML_TAG, SERIES, SOURCE_SIGNALS, SUBTITLE_HEADER, SUBTITLE_MARK, SUBTITLE_NUMBER, SUBTITLE_TIMING, TIER_DOMAINS, VENUE_NAME, VENUE_PHRASE, WHITE_SPACE


def strip(x: Column) -> Column:
    """White space off both ends, of any Unicode kind; trim() takes spaces only."""
    return F.btrim(x, F.lit(WHITE_SPACE))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def strip_subtitles(x: Column) -> Column:
    """Subtitle numbers, timings and the file header go, if there is a timing at all."""
    bare = x
    for pattern in (SUBTITLE_NUMBER, SUBTITLE_TIMING, SUBTITLE_HEADER):
        bare = F.regexp_replace(bare, pattern, "")
    return F.when(is_subtitles(x), bare).otherwise(x)


def is_subtitles(x: Column) -> Column:
    return x.rlike(SUBTITLE_MARK)


def normalise_space(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"\n{3,}", "\n\n"))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda t: t != ""))


def claims_of(x: Column) -> Column:
    """Sentences over 20 characters, at most three, each with its full stop again."""
    kept = F.filter(F.transform(F.split(x, "[.]"), strip), lambda s: F.length(s) > 20)
    return F.transform(F.slice(kept, 1, 3), lambda s: F.concat(s, F.lit(".")))


def tokens(x: Column) -> Column:
    """Distinct words of a text without case and marks."""
    plain = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def html_text(x: Column) -> Column:
    for pattern in [*HTML_HIDDEN, HTML_TAG, r"\s+"]:
        x = F.regexp_replace(x, pattern, " ")
    return strip(x)


def escape_html(x: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def title_case(x: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


#: Where a line may break: after white space, before or after dashes between words, after a hyphen between letters.
_WORD, _LETTER = r"[\p{L}\p{N}_]", r"[\p{L}\p{Nl}\p{No}_]"
_MARK = r"[\p{L}\p{N}_!\"'&.,?]"
_CHUNK = rf"( +|(?<={_MARK})-{{2,}}(?={_WORD})|[^ ]+?(?:-(?:(?<={_LETTER}{{2}}-)|(?<={_LETTER}-{_LETTER}-))(?={_LETTER}-?{_LETTER})|(?= |\z)|(?<={_MARK})(?=-{{2,}}{_WORD})))"


def shorten(x: Column, width: Column, mark: str = "…") -> Column:
    """As much of x, up to where a line may break, as fits in width with the mark; all of x if it fits.  White space becomes single spaces.

    A word that is longer than width may break after any hyphen that fits.
    """

    def cut(whole: Column) -> Column:
        room = width - len(mark)
        start = F.struct(F.lit("").alias("text"), F.lit("").alias("kept"), F.lit(None).cast("string").alias("rest"))

        def add(state: Column, chunk: Column) -> Column:
            longer = F.concat(state["text"], chunk)
            fits = state["rest"].isNull() & (F.length(longer) <= width)
            good = fits & (F.length(longer) <= room) & (chunk.substr(1, 1) != " ")
            return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), F.when(good, longer).otherwise(state["kept"]).alias("kept"), F.when(fits, state["rest"]).otherwise(F.coalesce(state["rest"], chunk)).alias("rest"))

        def within(state: Column) -> Column:
            head = F.substring(state["rest"], F.lit(1), width - F.length(state["text"]))
            after = F.length(head) - F.instr(F.reverse(head), "-") + 1  # characters up to the last hyphen
            breaks = (F.length(state["rest"]) > width) & F.contains(head, F.lit("-")) & F.substring(head, F.lit(1), after - 1).rlike("[^-]") & (F.length(state["text"]) + after <= room)
            return F.when(breaks, F.concat(state["text"], F.substring(head, F.lit(1), after))).otherwise(state["kept"])

        kept = F.aggregate(F.regexp_extract_all(whole, F.lit(_CHUNK), F.lit(1)), start, add, within)
        return F.when(F.length(whole) <= width, whole).otherwise(F.concat(kept, F.lit(mark)))

    return bound(F.array_join(F.filter(F.split(strip(x), f"[{WHITE_SPACE}]+"), lambda w: w != ""), " "), cut)


def find_date(x: Column) -> Column:
    """The first of the date forms, in order, that parses, in the first 500 characters."""
    head = F.substring(x, 1, 500)
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")), F.lit(form))) for pattern, form, _ in DATE_FORMATS))


def find_venue(x: Column) -> Column:
    head = F.substring(x, 1, 800)
    return F.coalesce(F.nullif(strip(F.regexp_extract(head, VENUE_PHRASE, 1)), F.lit("")), F.nullif(F.regexp_extract(head, VENUE_NAME, 0), F.lit("")))


def tier_of(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit("Other")
    for tier, domains in reversed(TIER_DOMAINS):
        out = F.when(reduce(Column.__or__, (F.contains(low, F.lit(d)) for d in domains)), tier).otherwise(out)
    return out


def is_economic(x: Column) -> Column:
    return F.lower(x).rlike("|".join(ECONOMIC_WORDS))


def series_of(x: Column) -> Column:
    """The data series of the first listed word that the text contains; null without any."""
    return F.coalesce(*(F.when(F.contains(F.lower(x), F.lit(word)), series) for word, series in SERIES))


def _literals(patterns: list[str]) -> dict[str, int]:
    """Patterns that are plain words between word bounds, and how often each is listed; none that shares a word with another."""
    plain = [p.removeprefix(r"\b").removesuffix(r"\b") for p in patterns if re.fullmatch(r"\\b[A-Za-z]+( [A-Za-z]+)*\\b", p)]
    words = Counter(w for p in set(plain) for w in set(p.lower().split()))
    return Counter(p for p in plain if all(words[w] == 1 for w in p.lower().split()))


def signals(x: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur at all; a pattern listed twice counts twice.

    Plain words are looked for together, in one pass over x; as none shares a word with another, no place is of two.
    """
    literals = _literals(patterns)
    rest = [p for p in patterns if p.removeprefix(r"\b").removesuffix(r"\b") not in literals]
    counts = [x.rlike("(?i)" + p).cast("int") for p in rest]
    if literals:
        found = F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)\b({'|'.join(literals)})\b"), F.lit(1)), F.lower))
        often = {w.lower(): n - 1 for w, n in literals.items() if n > 1}
        more = lambda f: reduce(Column.__add__, (F.array_contains(f, w).cast("int") * n for w, n in often.items()), F.size(f))
        counts.append(bound(found, more))
    return reduce(Column.__add__, counts)


def explanation_quality(x: Column) -> Column:
    score = 0.6 * F.least(signals(x, DATA_SIGNALS) / 5.0, F.lit(1.0)) + 0.4 * F.least(F.length(x) / 500.0, F.lit(1.0))
    return F.when(F.length(x) == 0, 0.0).otherwise(score)


def source_citation(x: Column) -> Column:
    return F.when(F.length(x) == 0, 0.0).otherwise(F.least(signals(x, SOURCE_SIGNALS) / 3.0, F.lit(1.0)))


def parsimony(tokens: Column, low: int = 500, high: int = 2000) -> Column:
    return F.when(tokens <= low, 1.0).when(tokens >= high, 0.0).otherwise(1.0 - (tokens - low) / float(high - low))


def cache_key(x: Column) -> Column:
    return F.substring(F.sha2(F.lower(strip(x)), 256), 1, 16)

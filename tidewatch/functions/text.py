"""Text derivations as Column expressions: classifiers, cleaning, clipping, search."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.functions import vocabulary as V

# Characters removed by ``strip``: ASCII and Unicode white space.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(text: Column) -> Column:
    """Trim white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def non_empty(text: Column) -> Column:
    """Null for null or empty text, else the text."""
    return F.nullif(text, F.lit(""))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def classify_topic(title: Column) -> Column:
    """First matching topic gate, or null."""
    (first, pattern), *rest = V.TOPIC_PATTERNS
    topic = F.when(title.rlike("(?i)" + pattern), first)
    for name, pattern in rest:
        topic = topic.when(title.rlike("(?i)" + pattern), name)
    return topic


def classify_severity(title: Column, tone: Column) -> Column:
    return (
        F.when(title.rlike("(?i)" + V.CRITICAL_PATTERN) | (tone <= V.TONE_CRITICAL), "critical")
        .when(tone <= V.TONE_ESCALATING, "escalating")
        .when(tone >= V.TONE_DEESC, "deesc")
        .otherwise("watching")
    )


def is_english(language: Column) -> Column:
    lowered = F.lower(F.coalesce(language, F.lit("")))
    return lowered.startswith("english") | (lowered == "en")


def story_title(title: Column) -> Column:
    """Lower-case letters, digits and spaces only, first 60 characters."""
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""), 1, 60)


def lens_text(title: Column, summary: Column) -> Column:
    return F.concat_ws(" ", title, F.coalesce(summary, F.lit("")))


def matches_terms(title: Column, summary: Column, pattern: str) -> Column:
    return lens_text(title, summary).rlike("(?i)" + pattern)


def contains_text(query: str, *fields: Column) -> Column:
    """Literal, case-insensitive containment over the space-joined fields."""
    haystack = F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields))
    return F.lower(haystack).contains(query.strip().lower())


def clip(text: Column, width: int = 104) -> Column:
    """Collapse white space and shorten to ``width`` characters, marking the cut."""
    flat = collapse_spaces(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, width - 3)), F.lit("…"))
    return F.when(F.length(flat) > width, cut).otherwise(flat)


def strip_markup(markup: Column) -> Column:
    """Drop script and style blocks, turn block tags into spaces, drop other tags."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    spaced = F.regexp_replace(bare, r"(?i)</?(p|br|div|li|tr|h\d|ul|ol|table)[^>]*>", " ")
    return F.regexp_replace(spaced, r"<[^>]+>", "")


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_closed(values: pd.Series) -> pd.Series:
    closed = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[A-Za-z][A-Za-z0-9]*);")
    known = lambda told: html.unescape(told) if told[1] == "#" else html5.get(told[1:], told)
    return values.map(lambda x: closed.sub(lambda m: known(m.group()), x), na_action="ignore")


def unescape_common(text: Column) -> Column:
    """The entities that dominate real pages, decoded without leaving the JVM."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text(markup: Column, *, every_entity: bool = True, unclosed: bool = True, limit: int | None = None) -> Column:
    """Readable text of an HTML fragment.

    ``every_entity`` decodes the complete entity table in an Arrow batch;
    otherwise only the common entities are decoded, natively. ``unclosed`` also decodes what browsers
    take for an entity without its semicolon (``&amp``, ``&copy2``); otherwise that is text.
    """
    bare = strip_markup(markup)
    whole = _unescape if unclosed else _unescape_closed
    text = collapse_spaces(whole(bare) if every_entity else unescape_common(bare))
    return text if limit is None else F.substring(text, 1, limit)


def country_label(code: Column) -> Column:
    return F.coalesce(non_empty(strip(F.upper(code))), F.lit("??"))

"""Titles to phrases: tokens, contiguous word groups, canonical parts of text. Column to Column, JVM-side."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewater.config import STOP_WORDS

TOKEN = r"([\p{L}\p{Nl}\p{No}][\p{L}\p{N}_-]{2,39})"

#: A digit of any kind: decimal ones, and those that are digits without being decimal (superscripts, circled ones and so on).
DIGIT = r"[\p{Nd}" + "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd") + "]"


def tokens(text: Column) -> Column:
    """Lower-case tokens: a letter and 2 to 39 more letters, digits, underscores or hyphens; shorter words vanish."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))
    return F.filter(found, lambda t: ~t.rlike(r"^\p{N}+$"))


def phrases(text: Column, sizes: Sequence[int] = (2, 3), stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct groups of neighbouring tokens without stop words and digits; an empty array for NULL and short texts."""
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    banned = F.array(*[F.lit(w) for w in stop])

    def of_size(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        groups = F.transform(starts, lambda i: F.slice(words, i, n))
        clean = F.filter(groups, lambda g: ~F.arrays_overlap(g, banned) & ~F.exists(g, lambda w: w.rlike(DIGIT)))
        return F.transform(clean, lambda g: F.array_join(g, " "))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def stripped(text: Column) -> Column:
    """``text`` without ASCII white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_publisher(title: Column) -> Column:
    """The title up to its last " - "."""
    return stripped(F.regexp_replace(title, r"(?s)^(.*) - .*$", "$1"))


@F.pandas_udf(StringType())
def _resolved(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """``text`` with all named and numeric entities resolved once. Only texts with an ampersand go through Python."""
    return F.coalesce(_resolved(F.when(F.contains(text, F.lit("&")), text)), text)


def scheme(url: Column) -> Column:
    """The lower-case scheme of an address; empty without one."""
    return F.lower(F.regexp_extract(F.ltrim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The lower-case authority of an address; empty without one."""
    return F.lower(F.regexp_extract(F.ltrim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def quoted(text: Column) -> Column:
    """Percent-encoding of a path: spaces as %20, slashes kept."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def published(text: Column) -> Column:
    """The instant of an RFC 2822 or ISO 8601 date; NULL if unreadable. Dates without a zone are UTC."""
    bare = F.regexp_replace(stripped(text), r"^[A-Za-z]{3},\s*", "")
    pattern = F.lit("d MMM yyyy HH:mm:ss xx")
    named = F.lit("d MMM yyyy HH:mm:ss z")
    return F.coalesce(F.try_to_timestamp(bare, pattern), F.try_to_timestamp(bare, named), F.try_to_timestamp(bare))

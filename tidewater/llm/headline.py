"""Canonical forms of headlines and web addresses, and the lexicon that tells ordinary words from identifying ones."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import parse_qsl, unquote

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
#: The same for texts of ASCII signs, in which it is found faster.
ASCII_WORD = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+")
LABEL = re.compile(r"^\W*((?:[^\W\d_]+[^\w|:–—.]{1,2}){0,2}[^\W\d_]+)(?:\s*[:|–—]|\s+-(?=\s)|\.(?=\s))\s*(?=\S)")
OUTLET = re.compile(r"\s[-–—|]\s+\S+(?:\s+\S+){0,2}\s*$")
#: The share of titles from which an ordinary word is established.
ESTABLISHED = 1e-3
#: Query parameters that only track where a reader came from (fixed values).
TRACKING = {"fbclid", "gclid", "ref", "mc_cid", "mc_eid", "igshid", "cmpid", "source_ref"}


@lru_cache(maxsize=200_000)
def _plain_word(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).casefold()


def words_of(text: str) -> list[str]:
    """The words and figures of a text as they are written."""
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def unescaped(title: str) -> str:
    """Entities resolved (also doubly written ones), signs composed, white space runs as one space."""
    if "&" in title:
        title = html.unescape(html.unescape(title))
    if not title.isascii():
        title = unicodedata.normalize("NFC", title)
    return " ".join(title.split())


def split_label(title: str) -> tuple[str, str]:
    """A leading label of up to three words without figures ("Update: ...") in plain form, and the rest; of an
    :func:`unescaped` title."""
    # looking for a sign is much cheaper than the pattern, which needs one of these
    m = LABEL.match(title) if ":" in title or " -" in title or ". " in title or "|" in title or "–" in title or "—" in title else None
    if not m or len(title) - m.end() < 12:
        return "", title
    return " ".join(_plain_word(w) for w in WORD.findall(m.group(1))), title[m.end() :]


def url_key(url: str | None) -> str | None:
    """One form for all ways to write a web address; None for what is no address.

    Scheme http or https, www, default ports, the host's letter case, fragments, tracking parameters, the order of
    parameters, percent-encoding of ordinary signs and a closing slash make no difference.
    """
    if url is None:
        return None
    u = url.strip()
    scheme, colon, rest = u.partition("//")
    scheme = scheme.lower()
    if not colon or (scheme and not scheme.endswith(":")):
        return None
    rest = rest.partition("#")[0]
    where, _, query = rest.partition("?")
    host, _, path = where.partition("/")
    host = host.rpartition("@")[2].lower()
    if host.endswith((":443", ":80")):
        host = host.rpartition(":")[0]
    host = host.removeprefix("www.")
    if not host:
        return None
    if scheme not in ("", "http:", "https:"):
        host = scheme + host
    if "%" in path:
        path = unquote(path)
    key = f"{host}/{path.rstrip('/')}"
    if not query:
        return key
    kept = sorted(f"{k}={v}" for k, v in parse_qsl(query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING) if "%" in query or "+" in query else sorted(x for x in query.split("&") if x and not x.lower().startswith("utm_") and x.partition("=")[0].lower() not in TRACKING)
    return f"{key}?{'&'.join(kept)}" if kept else key


def without_outlet(title: str) -> str:
    """An :func:`unescaped` title without the outlet of up to three words that it ends with."""
    return OUTLET.sub("", title) if " - " in title or " — " in title or " | " in title or " – " in title else title


def _cuts(word: str) -> set[str]:
    """The word, and the word without any one letter: words one slip apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def shortened(words: Iterable[str]) -> dict[str, list[str]]:
    """Shortened form to the words that have it, for looking up slips of the pen."""
    out: dict[str, list[str]] = {}
    for w in words:
        if len(w) > 3:
            for cut in _cuts(w):
                out.setdefault(cut, []).append(w)
    return out


def one_slip(a: str, b: str) -> bool:
    """Whether one letter inserted, left out, replaced or swapped with the next turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


class Lexicon:
    """Ordinary words with their share of titles, and the labels that head titles.

    A word that isn't ordinary identifies a story: a name or a figure. ``capital`` are the ordinary words that are mostly
    written as names are.
    """

    def __init__(self, shares: dict[str, float], capital: set[str], labels: set[str], established: float) -> None:
        self.shares, self.capital, self.labels, self.established = shares, capital, labels, established
        self.forms: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.slips: dict[str, str] = {}
        self.cuts = shortened(shares)

    def canonical(self, word: str, as_name: bool) -> str:
        """``word``, or the ordinary word that it is one slip of the pen away from.

        as_name: the word is written as names are, so that only words usually written so are tried.
        """
        if word in self.shares or not word.isalpha() or len(word) < 4:
            return word
        near = set(self.cuts.get(word, ()))
        for i in range(len(word)):
            # most words are near to none
            if cut := self.cuts.get(word[:i] + word[i + 1 :]):
                near.update(cut)
        found = [w for w in near if (not as_name or w in self.capital) and one_slip(word, w)]
        return max(found, key=lambda w: (self.shares[w], w)) if found else word

    def tokens(self, title: str) -> list[str]:
        """Canonical words of a headline without label and outlet."""
        return self.parsed(title)[0]

    def parsed(self, title: str) -> tuple[list[str], str, list[str]]:
        """Canonical words, the label that heads the title (also one that isn't left out), and the words taken for slips."""
        text = unescaped(title)
        label, rest = split_label(text)
        if label and label in self.labels:
            text = rest
        raw = words_of(without_outlet(text))
        if not raw:
            return [], label, []
        # the first word, and all words of titles in one case, tell nothing by their capitals
        mixed = not (text.islower() or text.isupper()) and any(w[0].islower() and len(w) > 3 for w in raw[1:])
        plain, cased = self.forms
        out = [plain.get(raw[0]) or self._form(raw[0], False)]
        known = cased if mixed else plain
        out += [known.get(w) or self._form(w, mixed) for w in raw[1:]]
        return out, label, [self.slips[w] for w in filter(self.slips.__contains__, raw)]

    def _form(self, raw: str, mixed: bool) -> str:
        kept = self.forms[mixed]
        if len(kept) > 300_000:
            kept.clear()
        plain = raw.lower() if raw.isascii() else _plain_word(raw)
        word = kept[raw] = self.canonical(plain, mixed and raw[0].isupper())
        if word != plain:
            if len(self.slips) > 300_000:
                # all go together, so that a form is never remembered without its slip
                self.slips.clear(), self.forms[0].clear(), self.forms[1].clear()
            self.slips[raw] = plain
        return word

    def ordinary(self, word: str) -> bool:
        return word in self.shares


COUNT_SCHEMA = "word string, n long, low long"
#: Marks of rows that count labels, and all titles, among the counts of words.
LABEL_MARK, TITLES_MARK = "\1", "\2"


def word_counts(titles: DataFrame) -> DataFrame:
    """word, n, low: in how many titles every plain word stands, and how often in lower case inside of mixed-case titles.

    Also has rows for labels and one for the number of titles. Counts of several sets of titles may be added up.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, lower, labels, n = Counter(), Counter(), Counter(), 0

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": [*total, *(LABEL_MARK + x for x in labels)], "n": [*total.values(), *labels.values()], "low": [*(lower[w] for w in total), *([0] * len(labels))]})
            total.clear(), lower.clear(), labels.clear()
            return frame

        for batch in batches:
            n += len(batch)
            for title in batch["title"]:
                text = unescaped(title)
                label, rest = split_label(text)
                if label:
                    labels[label] += 1
                raw = words_of(text)
                total.update({w.lower() if w.isascii() else _plain_word(w) for w in raw if not w[0].isdigit()})
                if not text.isupper() and not text.islower() and any(w[0].isupper() for w in raw[1:]):
                    lower.update({w if w.isascii() else _plain_word(w) for w in raw if w.islower()})
            if len(total) > 300_000:
                yield out()
        if total or labels:
            yield out()
        if n:
            yield pd.DataFrame({"word": [TITLES_MARK], "n": [n], "low": [0]})

    parts = titles.select("title").where(F.col("title").isNotNull()).mapInPandas(count, COUNT_SCHEMA)
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))


def grown_lexicon(counts: DataFrame, before: Lexicon | None = None, *, lower_share: float = 3e-5, any_share: float = 3e-3, established: float = ESTABLISHED) -> Lexicon:
    """The lexicon of :func:`word_counts`, one or several of them; words and labels of the lexicon ``before`` stay.

    A word is ordinary if it stands in lower case inside mixed-case titles in the share ``lower_share`` of titles (2 at
    least), or in any form in the share ``any_share`` (6 at least). So there are at most words-per-title / ``lower_share``
    entries, a bound that doesn't grow with the rows, and no more than these reach the driver.
    """
    n = counts.where(F.col("word") == TITLES_MARK).agg(F.sum("n")).first()[0] or 0
    least_low, least_any = max(2, lower_share * n), max(6, any_share * n)
    crosses = (F.col("low") >= least_low) | (F.col("n") >= F.when(F.col("word").startswith(LABEL_MARK), least_low).otherwise(least_any))
    summed = counts.where(F.col("word") != TITLES_MARK).groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
    rows = summed.where(crosses).collect()
    words = {r.word: r for r in rows if r.word[0] != LABEL_MARK}
    shares = {w: r.n / n for w, r in words.items()}
    capital = {w for w, r in words.items() if r.low < 0.5 * r.n}
    labels = {r.word[1:] for r in rows if r.word[0] == LABEL_MARK}
    if before is not None:
        shares, capital, labels = before.shares | shares, capital | (before.capital - words.keys()), labels | before.labels
    return Lexicon(shares, capital, labels, established)


def fit_lexicon(titles: DataFrame) -> Lexicon:
    """The lexicon of a column ``title``, from counts over all rows."""
    return grown_lexicon(word_counts(titles))


@lru_cache(maxsize=200_000)
def weight(word: str) -> int:
    """The weight of an identifying word in the metric: a fixed number from 1 to 2**50."""
    return (xxhash.xxh64_intdigest(word) >> 14) + 1


def key64(text: str) -> int:
    """A signed 64-bit key of a text."""
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


def part_of(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts

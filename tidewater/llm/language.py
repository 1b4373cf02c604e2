"""Missing or wrong language labels: bit-sliced Bloom filters of n-grams, one bit per language.

All languages share one array of bytes. A slot's byte has a bit for each language that put an n-gram there, so a lookup of
an n-gram reads a few bytes and their AND is the set of all languages that contain it. A word's hits are counted per
language, corrected for the hits that the filter's filling gives by chance, and turned into log shares; a text goes to the
languages of the sequence of segments with the largest sum, where every cut has to raise it enough. A segment of which
the best language knows too few n-grams is in another language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.headline import OUTLET, unescaped

LANGUAGES = ("en", "fr", "de", "es", "it")
#: Three-letter codes of ISO 639-2 (fixed values).
THREE_LETTER = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it"}
WORD = re.compile(r"[^\W\d_]+")
SLOTS, HASHES = 1 << 20, 3


def grams(word: str) -> list[str]:
    """The word itself and its runs of 3 to 5 signs, the marked ends included."""
    w = f"^{word}$"
    return [w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1) if n < len(w))]


def _slots(gram: str) -> list[int]:
    h = xxhash.xxh64_intdigest(gram)
    return [(h >> (20 * i)) & (SLOTS - 1) for i in range(HASHES)]


def folded(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()


class Filters:
    """The bit-sliced filters, and log shares per word."""

    def __init__(self, sets: dict[str, set[str]]) -> None:
        self.bits = np.zeros(SLOTS, dtype="uint8")
        for i, lang in enumerate(LANGUAGES):
            for gram in sets.get(lang, ()):
                for slot in _slots(gram):
                    self.bits[slot] |= 1 << i
        filled = np.array([((self.bits >> i) & 1).mean() for i in range(len(LANGUAGES))])
        self.chance = filled**HASHES

    def languages(self, gram: str) -> int:
        """The bit mask of all languages that contain an n-gram."""
        mask = 0xFF
        for slot in _slots(gram):
            mask &= int(self.bits[slot])
        return mask

    def shares(self, word: str) -> list[float]:
        """Log shares of the languages for one word (equal ones tell nothing), and the share of its n-grams that each knows."""
        g = grams(word)
        masks = np.array([self.languages(x) for x in g], dtype="uint8")
        weight = np.array([3.0 if len(x) == len(word) + 2 else 1.0 for x in g])
        hits = ((masks[:, None] >> np.arange(len(LANGUAGES))) & 1) * weight[:, None]
        counts = np.maximum(0.0, (hits.sum(axis=0) - weight.sum() * self.chance) / (1 - self.chance))
        p = (counts + 0.5) / (counts.sum() + 0.5 * len(LANGUAGES))
        return [*np.log(p * len(LANGUAGES)), *np.minimum(1.0, counts / weight.sum())]


def fit_filters(samples: DataFrame, labelled: DataFrame | None = None, *, rows_per_language: int = 20_000, kept_share: float = 0.15) -> Filters:
    """Filters from true samples (lang, text) and, for breadth, declared labels (lang, text).

    Of the declared ones at most ``rows_per_language`` rows of each language are used, chosen by a hash of the text, so the
    fit is bounded and doesn't depend on the order of rows. Declared labels may be wrong: an n-gram belongs to a language
    only if its share of that language's texts is at least ``kept_share`` of its largest share, and is in two texts.
    """
    rows = [(r.lang, r.text, 1) for r in samples.select("lang", "text").where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).limit(rows_per_language).collect()]
    if labelled is not None:
        h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
        sized = labelled.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("lang", "text", h.alias("h"))
        n = {r.lang: r.n for r in sized.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        cut = F.lit(0)
        for lang, k in n.items():
            cut = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, 0.9 * rows_per_language / k)))).otherwise(cut)
        rows += [(r.lang, r.text, 0) for r in sized.where(F.col("h") < cut).select("lang", "text").limit(rows_per_language * len(LANGUAGES)).collect()]
    seen: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    memo: dict[str, list[str]] = {}
    for lang, text, _ in rows:
        total[lang] += 1
        found: set[str] = set()
        for w in {folded(w) for w in WORD.findall(OUTLET.sub("", unescaped(text)))}:
            if w not in memo:
                memo[w] = grams(w)
            found.update(memo[w])
        seen[lang].update(found)
    best: dict[str, float] = defaultdict(float)
    for lang, counts in seen.items():
        for gram, k in counts.items():
            best[gram] = max(best[gram], k / total[lang])
    return Filters({lang: {g for g, k in counts.items() if k >= 2 and k / total[lang] >= kept_share * best[g]} for lang, counts in seen.items()})


def label_language(c: Column) -> Column:
    """The language of a declared label: its first part in lower case, three-letter forms as two-letter ones; NULL for
    missing, empty and undetermined labels."""
    first = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)", 1))
    codes = F.create_map(*[F.lit(x) for pair in THREE_LETTER.items() for x in pair])
    return F.when(first.isin("", "und"), F.lit(None)).otherwise(F.coalesce(codes[first], first))


SEGMENT_SCHEMA = "segment int, parts int, begin int, end int, detected string, confidence double"
#: What a segment in none of the languages is given.
OTHER = "other"


def _best_run(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of every text the largest sum of a run of words in one other language over the text's best language."""
    best = np.zeros(len(sizes))
    total = np.add.reduceat(np.vstack([x, np.zeros((1, x.shape[1]))]), starts, axis=0) if len(starts) else np.zeros((0, x.shape[1]))
    total[sizes == 0] = 0.0
    lead = total.argmax(axis=1)
    run = np.zeros((len(sizes), x.shape[1]))
    order = np.argsort(-sizes, kind="stable")
    left = len(order)
    for k in range(int(sizes.max(initial=0))):
        while left and sizes[order[left - 1]] <= k:
            left -= 1
        at = order[:left]
        row = x[starts[at] + k]
        run[at] = np.maximum(0.0, run[at] + row - row[np.arange(left), lead[at]][:, None])
        best[at] = np.maximum(best[at], run[at].max(axis=1))
    return best


def segmented(x: np.ndarray, gain: float, least: int) -> list[tuple[int, int, int]]:
    """begin, end, language of the segments of a text of words x languages: the largest sum less ``gain`` for every cut,
    with at least ``least`` words in each segment."""
    n, languages = x.shape
    if n < 2 * least:
        return [(0, n, int(x.sum(axis=0).argmax()) if n else 0)]
    cum = np.vstack([np.zeros((1, languages)), np.cumsum(x, axis=0)])
    value = np.full((n + 1, languages), -np.inf)
    start = np.zeros((n + 1, languages), dtype=int)
    come = np.full((n + 1, languages), -1)
    value[least] = cum[least]
    for k in range(least + 1, n + 1):
        value[k], start[k], come[k] = value[k - 1] + x[k - 1], start[k - 1], come[k - 1]
        if k >= 2 * least:
            best = value[k - least]
            lead = int(best.argmax())
            cut = best[lead] - gain + cum[k] - cum[k - least]
            cut[lead] = -np.inf
            better = cut > value[k]
            value[k, better], start[k, better], come[k, better] = cut[better], k - least, lead
    out, end, lang = [], n, int(value[n].argmax())
    while lang >= 0:
        begin = int(start[end, lang])
        out.append((begin, end, lang))
        end, lang = begin, int(come[end, lang])
    return out[::-1]


def detect(df: DataFrame, column: str, keys: list[str], filters: Filters, *, gain: float = 6.0, least_words: int = 4, known: float = 0.2) -> DataFrame:
    """keys, segment, parts, begin, end, detected, confidence: one row per text, or one per language segment.

    begin and end are character positions in the text with entities resolved and without an outlet at its end. A text is
    cut, as often as it pays, where the sum of log shares rises by ``gain`` for each cut with ``least_words`` words in each
    part (dynamic programming over the words). Texts that are NULL have no row; texts without letters or without any known
    n-gram have language NULL and confidence 0. Confidence is the share of the best language against the runner-up, times
    the share of the segment's n-grams that the best language knows against twice ``known``, if that is less; below
    ``known`` the segment is OTHER.
    """
    kinds, width = dict(df.dtypes), len(LANGUAGES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        table, used = np.zeros((1 << 14, 2 * width)), 0
        for batch in batches:
            texts = [OUTLET.sub("", unescaped(t)) for t in batch[column]]
            if not texts:
                continue
            ids, sizes = [], []
            get = memo.get
            for text in texts:
                found = WORD.findall(text)
                for raw in found:
                    i = get(raw)
                    if i is None:
                        w = folded(raw)
                        i = get(w)
                        if i is None:
                            if used == len(table):
                                table = np.vstack([table, np.zeros_like(table)])
                            table[used] = filters.shares(w)
                            i = memo[w] = used
                            used += 1
                        memo[raw] = i
                    ids.append(i)
                sizes.append(len(found))
            sizes = np.array(sizes, dtype=int)
            starts = np.cumsum(sizes) - sizes
            x = table[ids] if ids else np.zeros((0, 2 * width))
            cum = np.vstack([np.zeros((1, 2 * width)), np.cumsum(x, axis=0)])
            # only where a run of words is better off in another language than the text can a cut pay
            mixed = (_best_run(x[:, :width], starts, sizes) >= gain) & (sizes >= 2 * least_words)
            rows, seg, count, begin, end, low, high = [], [], [], [], [], [], []
            for i, text in enumerate(texts):
                parts = segmented(x[starts[i] : starts[i] + sizes[i], :width], gain, least_words) if mixed[i] else [(0, sizes[i], 0)]
                places = [0, *([m.start() for m in WORD.finditer(text)][p[0]] for p in parts[1:]), len(text)] if len(parts) > 1 else [0, len(text)]
                for k, (a, b, _) in enumerate(parts):
                    rows.append(i)
                    seg.append(k)
                    count.append(len(parts))
                    begin.append(places[k])
                    end.append(places[k + 1])
                    low.append(starts[i] + a)
                    high.append(starts[i] + b)
            low, high = np.array(low), np.array(high)
            sums = cum[high] - cum[low]
            score, top = sums[:, :width], sums[:, :width].argmax(axis=1)
            held = sums[np.arange(len(top)), width + top] / np.maximum(1, high - low)
            ordered = np.sort(score, axis=1)
            lead = np.minimum(50.0, ordered[:, -1] - ordered[:, -2])
            sure = lead > 1e-9
            names = np.where(held < known, OTHER, np.array(LANGUAGES, dtype=object)[top])
            lang = [n if ok else None for n, ok in zip(names, sure)]
            conf = np.where(sure, 1 / (1 + np.exp(-lead)) * np.minimum(1.0, held / (2 * known)), 0.0)
            out = {k: batch[k].to_numpy()[rows] for k in keys}
            yield pd.DataFrame(out | {"segment": np.array(seg, dtype="int32"), "parts": np.array(count, dtype="int32"), "begin": np.array(begin, dtype="int32"), "end": np.array(end, dtype="int32"), "detected": lang, "confidence": conf})
            if used > 800_000 or len(memo) > 1_500_000:
                memo.clear()
                used = 0

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + SEGMENT_SCHEMA
    return df.select(*keys, column).where(F.col(column).isNotNull()).mapInPandas(run, schema)

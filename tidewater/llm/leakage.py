"""Evaluation passages in training texts: rare n-gram seeds, then Smith-Waterman alignment of words.

Which words of an item are rare is counted over all documents, outside of the places that hold this item, so that an
item's names stay rare however often it leaked, and an item's result doesn't depend on the other items. An n-gram of an item that holds a rare word is a seed; a document that
holds a seed is aligned with the item around the place of the seeds. The alignment's matches, and among them those of rare
words, decide, so that wording alone, with other names and figures, is no leak. Runs of RUN words and whole items that
stand there word for word are leaks whatever their words; every such run holds one of the item's marks, which are seeds too.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
MARKS = re.compile("[̀-ͯ]+")
SENTENCE = re.compile(r"[^.!?:]+[.!?:]+\s*")
SEED = 3
#: So many words of an item in a row are a leak.
RUN = 12
MATCH, MISS, GAP = 2, -1, -1
#: Words of test items that are held in the driver and sent to every task at once, the bound of what is broadcast; more are
#: handled in further rounds, which give the same rows.
ITEM_WORDS = 2_000_000


def words(text: str) -> list[str]:
    """Words without case and accents; signs and layout make no difference."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    return WORD.findall(text.casefold())


def without_instruction(eval_items: DataFrame, shared: int = 3) -> DataFrame:
    """item_id, text of the items without their opening instruction: a first sentence that opens ``shared`` items of all,
    unless it is all there is. NULL and empty items are left out."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [SENTENCE.match(t) for t in batch["text"]]
            rests = [t[m.end() :] if m else "" for t, m in zip(batch["text"], found)]
            enough = [len(words(r)) >= 5 for r in rests]
            yield pd.DataFrame({"item_id": batch["item_id"], "text": batch["text"], "opening": [m.group().strip() if m else None for m in found], "rest": [r if ok else None for r, ok in zip(rests, enough)]})

    items = eval_items.select("item_id", "text").where(F.length("text") > 0).withColumn("item_id", F.col("item_id").cast("long"))
    parts = items.mapInPandas(cut, "item_id long, text string, opening string, rest string")
    often = parts.where(F.col("opening").isNotNull()).groupBy("opening").agg(F.count("*").alias("n")).where(F.col("n") >= shared)
    return parts.join(often, "opening", "left").select("item_id", F.when(F.col("n").isNotNull() & F.col("rest").isNotNull(), F.col("rest")).otherwise(F.col("text")).alias("text"))


class Items:
    """Test items as words, and their seeds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.words: dict[int, list[str]] = {item: words(text) for item, text in rows}
        self.vocabulary = {w for ws in self.words.values() for w in ws}
        # of every RUN words in a row the one least used in the items is a mark, so that no run is without one
        often = Counter(w for ws in self.words.values() for w in ws)
        spots = defaultdict(set)
        for item, ws in self.words.items():
            for i in range(max(1, len(ws) - RUN + 1) if ws else 0):
                at = min(range(i, min(i + RUN, len(ws))), key=lambda k: (often[ws[k]], ws[k]))
                spots[ws[at]].add((item, at))
        self.spots = {w: sorted(places) for w, places in spots.items()}
        self.rare: dict[int, set[str]] = {}
        self.seeds: dict[tuple[str, ...], list[tuple[int, int]]] = {}

    def set_rare(self, rare: dict[int, set[str]]) -> None:
        self.rare = rare
        seeds = defaultdict(list)
        for item, ws in self.words.items():
            anchors = rare[item].union(w for w in ws if w in self.spots)
            for i in range(len(ws) - SEED + 1):
                gram = tuple(ws[i : i + SEED])
                if any(w in anchors for w in gram):
                    seeds[gram].append((item, i))
        self.seeds = dict(seeds)
        # only around these words is anything looked up; items shorter than a seed are found by their runs
        self.anchors = self.spots.keys() | {w for names in rare.values() for w in names}

    def runs(self, ws: list[str], at: list[int] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """item, place in the item, place in ``ws`` and length of every run of RUN words, or the whole item, word for word;
        ``at`` are the places of all marks, if known."""
        done: dict[tuple[int, int], int] = {}
        for j in range(len(ws)) if at is None else at:
            for item, i in self.spots.get(ws[j], ()):
                if done.get((item, j - i), 0) > j:
                    continue
                own, lo, hi = self.words[item], 0, 1
                while lo < min(i, j) and own[i - lo - 1] == ws[j - lo - 1]:
                    lo += 1
                while i + hi < len(own) and j + hi < len(ws) and own[i + hi] == ws[j + hi]:
                    hi += 1
                done[item, j - i] = j + hi
                if lo + hi >= min(RUN, len(own)):
                    yield item, i - lo, j - lo, lo + hi


def margin(own: list[str]) -> int:
    """How far words added or left out may move a place of an item."""
    return len(own) // 3 + 8


def rare_words(documents: DataFrame, items: Items, *, share: float = 0.005, least: int = 5, whole: float = 0.75, whole_rare: float = 0.6) -> dict[int, set[str]]:
    """Of every item the words in at most the share ``share`` of all documents (``least`` documents at least), apart from
    the places that hold this item: around its runs of RUN words, and, if it has many of these, in documents with ``whole``
    of its words and ``whole_rare`` of the quarter of them that is least used elsewhere."""
    vocabulary, marks = items.vocabulary, items.spots.keys()
    schema = "item long, word string, n long"

    def rows(found: Counter) -> pd.DataFrame:
        return pd.DataFrame({"item": pd.array([i for i, _ in found], dtype="Int64"), "word": [w for _, w in found], "n": list(found.values())}).astype({"word": object, "n": "int64"})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held, n = Counter(), Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                ws = words(text)
                here = vocabulary.intersection(ws)
                found.update(here)
                if not marks.isdisjoint(here) and (runs := list(items.runs(ws))):
                    places = defaultdict(lambda: np.zeros(len(ws), dtype=bool))
                    for item, i, j, _ in runs:
                        own = items.words[item]
                        places[item][max(0, j - i - margin(own)) : j - i + len(own) + margin(own)] = True
                    for item, at in places.items():
                        outside = {w for w, h in zip(ws, at.tolist()) if not h}
                        held.update((item, w) for w in here.intersection(items.words[item]) if w not in outside)
                        held[item, None] += 1
            n += len(batch)
        yield rows(Counter({(None, w): k for w, k in found.items()}) + held + Counter({(None, None): n}))

    # at most one row per word of the items, and one per item and word
    counts, held = Counter(), Counter()
    for r in documents.mapInPandas(count, schema).groupBy("item", "word").agg(F.sum("n").alias("n")).collect():
        (counts if r.item is None else held)[r.word if r.item is None else (r.item, r.word)] = r.n
    n = counts.pop(None, 0)
    most = max(least, share * n)
    hot = {}
    for item, ws in items.words.items():
        if held[item, None] > max(least, share * n / 5):
            own = sorted(set(ws), key=lambda w: (counts[w] - held[item, w], w))
            hot[item] = set(own), set(own[: max(3, len(own) // 4)])

    def count_edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edited = Counter()
        for batch in batches:
            for text in batch["text"]:
                ws = words(text)
                here = vocabulary.intersection(ws)
                near = [item for item, (own, names) in hot.items() if len(names & here) >= whole_rare * len(names) and len(own & here) >= whole * len(own)]
                if near:
                    exact = {r[0] for r in items.runs(ws)}
                    edited.update((item, w) for item in near if item not in exact for w in hot[item][0] & here)
        yield rows(edited)

    if hot:
        for r in documents.mapInPandas(count_edited, schema).groupBy("item", "word").agg(F.sum("n").alias("n")).collect():
            held[r.item, r.word] += r.n
    return {item: {w for w in ws if counts[w] - held[item, w] <= most} for item, ws in items.words.items()}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The best local alignment of two word lists (Smith-Waterman with linear gaps), as pairs of equal words."""
    code: dict[str, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in a])
    y = np.array([code.setdefault(w, len(code)) for w in b])
    h = np.zeros((len(a) + 1, len(b) + 1), dtype="int32")
    slope = -GAP * np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        row = np.zeros(len(b) + 1, dtype="int32")
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], MATCH, MISS), h[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    pairs = []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = x[i - 1] == y[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISS):
            if same:
                pairs.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def longest_run(pairs: list[tuple[int, int]], item: list[str], rare: set[str]) -> tuple[int, int]:
    """Length of the longest run of words in a row in both texts, and how many rare words it holds."""
    best, begin = (0, 0), 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] != pairs[k - 1][0] + 1 or pairs[k][1] != pairs[k - 1][1] + 1:
            run = pairs[begin:k]
            best = max(best, (len(run), sum(item[i] in rare for i, _ in run)))
            begin = k
    return best


LEAK_SCHEMA = "item_id long, matched double, matched_rare double, run int, run_rare int, begin int, end int"


def candidates(documents: DataFrame, items: Items, keys: list[str], *, whole: float = 0.75, whole_rare: float = 0.6, row: int = RUN) -> DataFrame:
    """keys, item_id, matched and matched_rare (shares of the item's words), run, run_rare, begin, end (word positions in
    the document) of every document and item that share a seed, from the place that is a leak and matches most, else from
    the one that matches most. Whole texts are read; NULL and empty texts have no row."""
    kinds = dict(documents.dtypes)

    def measured(own: list[str], rare: set[str], names: int, a: int, pairs: list[tuple[int, int]]) -> tuple:
        length, length_rare = longest_run(pairs, own, rare)
        return (len(pairs) / len(own), sum(own[i] in rare for i, _ in pairs) / max(1, names), length, length_rare, a + pairs[0][1], a + pairs[-1][1] + 1)

    def leak(place: tuple) -> bool:
        matched, matched_rare, length = place[:3]
        return (matched >= whole and matched_rare >= whole_rare) or matched == 1 or length >= row

    def aligned(own: list[str], rare: set[str], names: int, ws: list[str], hits: list[int], a: int, b: int) -> Iterator[tuple]:
        """The best alignment inside ws[a:b]; if that is no leak, also those of what lies before and after it."""
        parts = [(a, b)]
        while parts:
            a, b = parts.pop()
            pairs = align(own, ws[a:b])
            if not pairs:
                continue
            yield (place := measured(own, rare, names, a, pairs))
            if not leak(place):
                # every part has a seed of its own and room for a leak, so there are at most as many parts as seeds
                for lo, hi in ((a, place[4]), (place[5], b)):
                    if hi - lo >= min(row, whole * len(own)) and bisect_left(hits, lo) < bisect_left(hits, hi):
                        parts.append((lo, hi))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, anchors = items.seeds, items.anchors
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch["text"]):
                ws = words(text)
                hits = [i for i, w in enumerate(ws) if w in anchors]
                places: dict[int, list[tuple[int, int]]] = defaultdict(list)
                seen = -1
                for i in hits:
                    for j in range(max(i - SEED + 1, seen + 1, 0), i + 1):
                        seen = j
                        for item, offset in seeds.get(tuple(ws[j : j + SEED]), ()):
                            places[item].append((j - offset, j))
                if not hits:
                    continue
                exact: dict[int, tuple[int, int, int]] = {}
                for item, i, j, n in items.runs(ws, hits):
                    exact[item] = max(exact.get(item, (0, 0, 0)), (n, i, j))
                for item in {**places, **exact}:
                    own, rare, starts = items.words[item], items.rare[item], places.get(item, [])
                    names = sum(w in rare for w in own)
                    pad = margin(own)
                    # places of one item that lie apart are aligned apart; the best leak counts, however much others match
                    starts.sort()
                    of_item = sorted(j for _, j in starts)
                    found, lo = [], starts[0][0] if starts else 0
                    for (s, _), nxt in zip(starts, [*[s for s, _ in starts[1:]], None]):
                        if nxt is None or nxt - s > pad:
                            found += aligned(own, rare, names, ws, of_item, max(0, lo - pad), min(len(ws), s + len(own) + pad))
                            lo = nxt
                    if item in exact:
                        # an alignment may go past the longest run
                        n, i, j = exact[item]
                        found.append(measured(own, rare, names, 0, [(i + x, j + x) for x in range(n)]))
                    if found:
                        at.append(k)
                        out.append((item, *max(found, key=lambda place: (leak(place), place[0]))))
            if not out:
                continue
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in LEAK_SCHEMA.split(", ")]).astype({"run": "int32", "run_rare": "int32", "begin": "int32", "end": "int32"})
            yield pd.DataFrame({k: batch[k].to_numpy()[at] for k in keys} | {c: frame[c] for c in frame})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + LEAK_SCHEMA
    return documents.select(*keys, "text").where(F.length("text") > 0).mapInPandas(run, schema)


def leaks(documents: DataFrame, eval_items: DataFrame, keys: list[str], *, whole: float = 0.75, whole_rare: float = 0.6, row: int = RUN) -> DataFrame:
    """The candidates that are leaks: the whole item word for word or with at most some words changed (``whole`` of its
    words and ``whole_rare`` of its rare ones match in order), or ``row`` words in a row.

    documents: keys, text; eval_items: item_id, text (NULL and empty items match nothing; items of any number of words are
    found at any place). Items are taken in rounds of at most ITEM_WORDS words, each against all documents; what opens many
    items is counted over all of them before. Equal documents each have their rows; extra columns are ignored.
    """
    texts = documents.select(*keys, "text").where(F.length("text") > 0)
    out, rows, size = None, [], 0

    def found(part: list[tuple[int, str]]) -> DataFrame:
        items = Items(part)
        items.set_rare(rare_words(texts.select("text"), items, whole=whole, whole_rare=whole_rare))
        pairs = candidates(texts, items, keys, whole=whole, whole_rare=whole_rare, row=row)
        return pairs.where(((F.col("matched") >= whole) & (F.col("matched_rare") >= whole_rare)) | (F.col("matched") == 1) | (F.col("run") >= row))

    for r in without_instruction(eval_items).orderBy("item_id").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text) // 3
        if size >= ITEM_WORDS:
            part = found(rows)
            out, rows, size = (part if out is None else out.unionByName(part)), [], 0
    if rows or out is None:
        part = found(rows)
        out = part if out is None else out.unionByName(part)
    return out

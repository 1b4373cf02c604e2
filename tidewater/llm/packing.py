"""Filling containers of fixed capacity: optimal length buckets from the global histogram, then token-budget batches.

An item gets the room of its bucket's highest length. Dynamic programming over the histogram of all lengths chooses the
boundaries that leave the least padding, each further bucket counting as one small container more. Batches then form bucket by
bucket, longest first: as many items of the bucket as the budget allows, the rest of the budget filled from shorter
buckets. All this is arithmetic on counts per bucket; an item's number inside its bucket follows from counts per length and
task, so containers are assigned without sorting or gathering a bucket anywhere.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.runtime import written

#: The pattern that splits text before the merges of the vocabulary below (a fixed value that belongs to it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


PIECE_SCHEMA = "piece int, begin int, end int, tokens int, task int, number long"


def sized_pieces(df: DataFrame, keys: list[str], capacity: int, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """keys, piece, begin, end, tokens, task, number: texts in tokens of a public tokenizer, split only above ``capacity``.

    begin and end are token positions; all pieces of a long text but the last are full. task and number say which of the
    pieces of its length a piece is in the task that sized it. NULL and empty texts take no room and have no row.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, seen = _encoder(vocabulary, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            at, piece, begin, end, number = [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                n = len(encoder.encode_ordinary(text))
                for p, lo in enumerate(range(0, n, capacity)):
                    hi = min(n, lo + capacity)
                    at.append(k)
                    piece.append(p)
                    begin.append(lo)
                    end.append(hi)
                    number.append(seen[hi - lo])
                    seen[hi - lo] += 1
            if not at:
                continue
            b, e = np.array(begin, dtype="int32"), np.array(end, dtype="int32")
            yield pd.DataFrame({k: batch[k].to_numpy()[at] for k in keys} | {"piece": np.array(piece, dtype="int32"), "begin": b, "end": e, "tokens": e - b, "task": np.full(len(b), task, dtype="int32"), "number": np.array(number, dtype="int64")})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PIECE_SCHEMA
    return df.select(*keys, "text").where(F.length("text") > 0).mapInPandas(run, schema)


def best_buckets(histogram: dict[int, int], spare: int) -> list[tuple[int, int]]:
    """(lowest length, highest length) of the buckets that minimise padding plus ``spare`` per bucket.

    histogram: items by length. Exact: every set of boundaries among the lengths that occur is covered. Ties go to the
    wider bucket.
    """
    if not histogram:
        return []
    ends = np.array(sorted(histogram))
    items = np.concatenate([[0], np.cumsum([histogram[int(e)] for e in ends])])
    tokens = np.concatenate([[0], np.cumsum([histogram[int(e)] * int(e) for e in ends])])
    cost, back = np.zeros(len(ends) + 1), [0] * (len(ends) + 1)
    for j, h in enumerate(ends, start=1):
        total = cost[:j] + (items[j] - items[:j]) * h - (tokens[j] - tokens[:j]) + spare
        back[j] = int(total.argmin())
        cost[j] = total[back[j]]
    out, j = [], len(ends)
    while j:
        out.append((int(ends[back[j] - 1]) + 1 if back[j] else 0, int(ends[j - 1])))
        j = back[j]
    return out[::-1]


def batches(counts: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(bucket, first number, last number + 1, items per container, capacity, first container) of every batch part.

    counts: items by bucket (its highest length). Each step takes the longest bucket that has items left, tries each
    capacity that holds it, keeps the filling with the least unused share, and repeats that filling as often as all its
    buckets allow; so there are few steps, whatever the number of items.
    """
    left = {h: n for h, n in sorted(counts.items(), reverse=True) if n > 0}
    used = dict.fromkeys(left, 0)
    out, container = [], 0
    while left:
        longest = next(iter(left))
        best = None
        for c in sorted(capacities, reverse=True):
            rest, filling = c, {}
            for h, n in left.items():
                k = min(rest // h, n)
                if k:
                    filling[h], rest = k, rest - k * h
            if longest in filling and (best is None or rest / c < best[0]):
                best = (rest / c, c, filling)
        _, capacity, filling = best
        times = min(left[h] // k for h, k in filling.items())
        for h, k in filling.items():
            out.append((h, used[h], used[h] + times * k, k, capacity, container))
            used[h] += times * k
            left[h] -= times * k
            if not left[h]:
                del left[h]
        container += times
    return out


def pack(pieces: DataFrame, capacities: list[int], keys: list[str]) -> DataFrame:
    """keys, piece, begin, end, tokens, capacity, bucket, container: where every piece goes.

    container numbers are unique; the tokens in a container never exceed its capacity. Every piece goes to exactly one
    container, and pieces of one length are interchangeable. An empty table gives an empty one. At most as many rows as
    there are lengths up to the largest capacity reach the driver.
    """
    kept = written(pieces, "pieces")
    counts = kept.groupBy("tokens", "task").agg(F.count("*").alias("n"))
    totals = {r.tokens: r.n for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    rows: list[tuple[int, int, int]] = []
    sizes: dict[int, int] = {}
    for low, high in best_buckets(totals, min(capacities, default=0)):
        sizes[high] = 0
        for length in range(low, high + 1):
            if length in totals:
                rows.append((length, high, sizes[high]))
                sizes[high] += totals[length]
    parts = defaultdict(list)
    for bucket, *part in batches(sizes, capacities):
        parts[bucket].append(part)
    tables = {bucket: np.array(sorted(p), dtype="int64") for bucket, p in parts.items()}
    plan = pieces.sparkSession.createDataFrame(rows, "tokens int, bucket int, first long")
    earlier = F.sum("n").over(W.partitionBy("tokens").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("tokens", "task", F.coalesce(earlier, F.lit(0)).alias("start"))
    placed = kept.join(starts, ["tokens", "task"]).join(F.broadcast(plan), "tokens").withColumn("number", F.col("first") + F.col("start") + F.col("number"))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            capacity, container = np.zeros(len(frame), dtype="int64"), np.zeros(len(frame), dtype="int64")
            for bucket, at in frame.groupby("bucket").indices.items():
                t, n = tables[bucket], frame["number"].to_numpy()[at]
                part = t[np.searchsorted(t[:, 0], n, side="right") - 1]
                capacity[at], container[at] = part[:, 3], part[:, 4] + (n - part[:, 0]) // part[:, 2]
            yield frame.drop(columns="number").assign(capacity=capacity, container=container)

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece int, begin int, end int, tokens int, bucket int, capacity long, container long"
    return placed.select(*keys, "piece", "begin", "end", "tokens", "bucket", "number").mapInPandas(assign, schema)

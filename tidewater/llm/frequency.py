"""How often every distinct term occurs, and in how many records: a global integer dictionary and count arrays.

Every block of input (a task's rows) is counted where it is read, so a term costs one row per block, not one per
occurrence. The distinct terms are sorted into a dictionary of dense integers; the blocks' counts are encoded with it and
sent to the owners of identifier ranges, which sum them into two arrays per range. No step holds a term's occurrences or
the whole dictionary in one place.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import written

#: Identifiers per range, and distinct terms after which a task hands over a block.
RANGE = 8192
BLOCK = 200_000
ASCII_WORD, WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}+")
BLOCK_SCHEMA = "scope string, term string, occurrences long, records long"


def words(text: str) -> list[str]:
    """Maximal runs of letters of the composed, lower-case text."""
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()))


def text_blocks(df: DataFrame, column: str, scope: str) -> DataFrame:
    """Counts of the words of a text column by block; every row with a text is a record."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        occurrences, records = Counter(), Counter()

        def block() -> pd.DataFrame:
            out = pd.DataFrame({"scope": scope, "term": list(occurrences), "occurrences": list(occurrences.values()), "records": [records[t] for t in occurrences]})
            occurrences.clear(), records.clear()
            return out

        for batch in batches:
            for text in batch[column]:
                found = words(text)
                occurrences.update(found)
                records.update(set(found))
            if len(occurrences) >= BLOCK:
                yield block()
        if occurrences:
            yield block()

    return df.select(column).where(F.col(column).isNotNull()).mapInPandas(count, BLOCK_SCHEMA)


def row_blocks(df: DataFrame, scope: str) -> DataFrame:
    """Counts of rows that hold one term of one record each: term, figure (NULL and negative ones count as 0)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        occurrences, records = Counter(), Counter()

        def block() -> pd.DataFrame:
            out = pd.DataFrame({"scope": scope, "term": list(records), "occurrences": [occurrences[t] for t in records], "records": list(records.values())})
            occurrences.clear(), records.clear()
            return out

        for batch in batches:
            records.update(batch["term"])
            for term, n in zip(batch["term"], batch["figure"].fillna(0).clip(lower=0).astype("int64")):
                occurrences[term] += n
            if len(records) >= BLOCK:
                yield block()
        if records:
            yield block()

    return df.select("term", "figure").where(F.col("term").isNotNull()).mapInPandas(count, BLOCK_SCHEMA)


def dictionary(blocks: DataFrame) -> DataFrame:
    """scope, term, id: dense integers in the order of scope and term."""
    distinct = blocks.select("scope", "term").distinct()
    placed = distinct.repartitionByRange("scope", "term").sortWithinPartitions("scope", "term")
    mono = F.monotonically_increasing_id()
    placed = written(placed.select("scope", "term", F.shiftright(mono, 33).cast("int").alias("part"), mono.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "dictionary")
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = blocks.sparkSession.createDataFrame(offsets, "part int, start long")
    return placed.join(F.broadcast(starts), "part").select("scope", "term", (F.col("start") + F.col("at")).alias("id"))


def frequencies(blocks: DataFrame) -> DataFrame:
    """scope, term, id, occurrences, records over all blocks."""
    kept = written(blocks, "blocks")
    known = dictionary(kept)
    encoded = kept.join(known, ["scope", "term"]).select(F.floor(F.col("id") / RANGE).alias("range"), (F.col("id") % RANGE).cast("int").alias("at"), "occurrences", "records")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in batch.groupby("range"):
                if number not in arrays:
                    arrays[number] = np.zeros((2, RANGE), dtype="int64")
                np.add.at(arrays[number][0], part["at"].to_numpy(), part["occurrences"].to_numpy())
                np.add.at(arrays[number][1], part["at"].to_numpy(), part["records"].to_numpy())
        for number, a in arrays.items():
            at = np.nonzero(a[1])[0]
            yield pd.DataFrame({"id": number * RANGE + at, "occurrences": a[0][at], "records": a[1][at]})

    summed = encoded.repartition("range").mapInPandas(add, "id long, occurrences long, records long")
    return known.join(summed, "id").select("scope", "term", "id", "occurrences", "records")


def marked(counts: DataFrame, records: dict[str, int], *, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """Adds ``mark``: ``rare`` (in fewer than ``rare_below`` records), ``common`` (in at least ``common_share`` of the
    scope's records), else NULL. In a scope so small that both hold, a term is rare."""
    least = F.lit(None).cast("double")
    for scope, n in records.items():
        least = F.when(F.col("scope") == scope, F.lit(n * common_share)).otherwise(least)
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= least, "common"))

"""The N best items of every group by statistics-guided skipping.

The usable entries are stored clustered: a file holds neighbouring groups, or part of one group, and inside of a file the
first entries of all its groups come before their later ones, in small row groups. A task reads the row groups of its files
in descending maximum score, as the Parquet footers state it, and leaves out those that lie strictly below the N-th score
so far of every group they contain; which these are, the row group's own column of group keys tells. What is left, at most
N entries per group and file, is ranked once more. Range partitioning on (group, score) splits a group of any size over
many files, so no task ever holds a whole group. A clustered table serves any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.days import figure
from tidewater.runtime import written_at

ROW_GROUP = 64 * 1024
#: Entries of a group in the first part of a file; each further part holds three times what came before.
FIRST = 8


def _best(frame: pd.DataFrame, order: Sequence[tuple[str, bool]], n: int) -> pd.DataFrame:
    """The first ``n`` rows of each group; missing values come last."""
    ranked = frame.sort_values(["g__", *(c for c, _ in order)], ascending=[True, *(not down for _, down in order)], na_position="last", kind="stable")
    return ranked.groupby("g__", sort=False).head(n)


def _with_parts(score: str):
    """Adds the part of the file in which an entry stands, from its place among the entries of its group in this task, and
    the best score of that group there, so that groups of one level can lie together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, best = None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            g, groups = batch["g__"].to_numpy(), batch.groupby("g__", sort=False)
            # entries come sorted by group, so only the first group can go on from the batch before
            place = groups.cumcount().to_numpy() + np.where(g == last, seen, 0)
            lead = groups[score].transform("first").to_numpy().astype(float)
            if best is not None:
                lead = np.where(g == last, best, lead)
            last, seen, best = g[-1], int(place[-1]) + 1, lead[-1]
            part = np.where(place < FIRST, 0, 1 + np.floor(np.log(np.maximum(place, FIRST) / FIRST + 1e-9) / np.log(4))).astype("int32")
            yield batch.assign(part__=part, lead__=lead)

    return run


class Clustered:
    """Entries stored for top-n queries.

    order: (column, descending) from the most to the least important; the first is the score. Rows whose score is NULL,
    NaN or infinite are left out. NULL in a group column is a value of its own; further columns are ignored, whatever their
    names.
    """

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]]) -> None:
        self.spark, self.group, self.order = df.sparkSession, list(group), list(order)
        score, down = order[0]
        numeric = {c for c, kind in df.dtypes if kind in ("double", "float")}
        self.cols = list(dict.fromkeys([*group, *(c for c, _ in order)]))
        clean = df.select(*[figure(F.col(c)).alias(c) if c in numeric else F.col(c) for c in self.cols]).where(F.col(score).isNotNull())
        clean = clean.withColumn("g__", F.xxhash64(*group))
        first = F.col(score).desc() if down else F.col(score).asc()
        self.schema = clean.schema
        ordered = clean.repartitionByRange("g__", first).sortWithinPartitions("g__", first)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
        placed = ordered.mapInPandas(_with_parts(score), kinds + ", part__ int, lead__ double").sortWithinPartitions("part__", "lead__", "g__", first)
        self.table, self.path = written_at(placed, "topn", {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 200, "parquet.page.size.row.check.min": 200})

    def _read(self, n: int, report: bool) -> DataFrame | None:
        order, (score, best_first) = self.order, self.order[0]
        files = self.table.inputFiles()  # one name per written file, as any scan has them
        if not files:
            return None

        def best_of(uri: str) -> tuple[pd.DataFrame | None, tuple[str, int, int, int]]:
            where, name = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
            with where.open_input_file(name) as source:
                data = pq.ParquetFile(source)
                names = data.schema_arrow.names
                groups = []
                for i in range(data.num_row_groups):
                    s = data.metadata.row_group(i).column(names.index(score)).statistics
                    groups.append((np.inf if s is None or not s.has_min_max else s.max if best_first else -s.min, i))
                kept: pd.DataFrame | None = None
                floor: dict[int, float] = {}
                parts: list[pd.DataFrame] = []
                waiting = 0
                skipped = rows = 0
                columns = [c for c in names if c not in ("part__", "lead__")]
                for top, i in sorted(groups, key=lambda x: (-x[0], x[1])):
                    if floor and top < max(floor.values()):
                        contained = data.read_row_group(i, columns=["g__"])["g__"].unique().to_pylist()
                        if all(top < floor.get(g, -np.inf) for g in contained):
                            skipped += 1
                            continue
                    parts.append(data.read_row_group(i, columns=columns).to_pandas())
                    rows, waiting = rows + len(parts[-1]), waiting + len(parts[-1])
                    # ranking again costs what is kept, so it waits for an eighth of that
                    if kept is not None and 8 * waiting < len(kept):
                        continue
                    kept, parts, waiting = _best(pd.concat(parts if kept is None else [kept, *parts], ignore_index=True), order, n), [], 0
                    full = kept.groupby("g__")[score].agg(["size", "min" if best_first else "max"])
                    full = full[full["size"] >= n].iloc[:, 1]
                    floor = dict(zip(full.index, full if best_first else -full))
                if parts:
                    kept = _best(pd.concat([kept, *parts], ignore_index=True), order, n)
                return kept, (name.rpartition("/")[2], len(groups), skipped, rows)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for uri in batch["file"]:
                    kept, counts = best_of(uri)
                    if report:
                        yield pd.DataFrame([counts], columns=["file", "row_groups", "skipped", "rows_read"])
                    elif kept is not None:
                        yield kept

        listed = self.spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
        return listed.mapInPandas(read, "file string, row_groups long, skipped long, rows_read long" if report else self.schema)

    def top(self, n: int) -> DataFrame:
        """group columns, the columns of ``order`` and ``rank`` 1..n of the first ``n`` entries of every group.

        Missing values other than the score rank last; strings rank by code point. Entries that agree in every column are
        one candidate each, so repeated rows take several ranks unless removed before. A group with fewer entries gives
        all of them; an empty table gives an empty one.
        """
        parts = self._read(n, False)
        if parts is None:
            return self.table.select(*self.cols).limit(0).withColumn("rank", F.lit(0))
        keys = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in self.order]
        ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy(*self.group).orderBy(*keys)))
        return ranked.where(F.col("rank") <= n).select(*self.cols, "rank")

    def skipping(self, n: int) -> DataFrame:
        """file, row_groups, skipped, rows_read: what :meth:`top` reads of every file and leaves out."""
        report = self._read(n, True)
        return self.spark.createDataFrame([], "file string, row_groups long, skipped long, rows_read long") if report is None else report


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` rows of every group of a table that is clustered for this query; see :class:`Clustered`."""
    return Clustered(df, group, order).top(n)

"""The queries of the problems on training data, over whole tables and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.days import figure, parse_day
from tidewater.functions.terms import term_key
from tidewater.llm import encoding, frequency, history, language, leakage, packing, topn
from tidewater.operators.latest import latest_by
from tidewater.runtime import table, written


def _history(spark: SparkSession, sf: str, blocks: int) -> tuple[history.History, list[DataFrame]]:
    """A history of all items, which arrive in ``blocks`` consecutive blocks of batches, and what each block gave."""
    items = table(spark, sf, "observation")
    lo, hi = items.agg(F.min("batch_id"), F.max("batch_id")).first()
    store = history.History(spark)
    if lo is None:
        return store, []
    step = -(-(hi - lo + 1) // blocks)
    return store, [store.append(items.where(F.col("batch_id").between(at, at + step - 1))) for at in range(lo, hi + 1, step)]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every item that repeats a story: the first half of the batches is accepted, then the second is compared with it."""
    return _history(spark, sf, 2)[0].repeats()


def p2_appended(spark: SparkSession, sf: str, blocks: int = 4) -> DataFrame:
    """block, first_obs_id, obs_id: what each of several blocks gave on arrival, earlier items that were paired anew included."""
    found = [df.select(F.lit(i).alias("block"), "first_obs_id", "obs_id") for i, df in enumerate(_history(spark, sf, blocks)[1])]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "block int, first_obs_id long, obs_id long")


def p3_segments(spark: SparkSession, sf: str) -> DataFrame:
    """obs_id, declared, segment, parts, begin, end, detected, confidence for every title."""
    items = table(spark, sf, "observation").select("obs_id", "title", "lang")
    declared = items.select(language.label_language(F.col("lang")).alias("lang"), F.col("title").alias("text"))
    filters = language.fit_filters(table(spark, sf, "lang_samples"), declared)
    return language.detect(items.withColumnRenamed("lang", "declared"), "title", ["obs_id", "declared"], filters)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Titles whose label is missing or wrong, and every language of titles in several languages."""
    rows = p3_segments(spark, sf).where(F.col("detected").isin(*language.LANGUAGES))
    declared = language.label_language(F.col("declared"))
    return rows.where((F.col("parts") > 1) | declared.isNull() | (declared != F.col("detected"))).select("obs_id", F.col("detected").alias("lang")).distinct()


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    """scope, term, occurrences, records, mark of every term of both scopes."""
    raw = table(spark, sf, "snapshot_terms").select("source", parse_day(F.col("date")).alias("day"), term_key(F.col("term")).alias("term"), figure(F.col("count")).alias("figure"), "collected_at_utc")
    counted = written(latest_by(raw.where(F.col("day").isNotNull()), ["source", "day", "term"], [F.col("collected_at_utc")], ["figure"]), "counted")
    items = table(spark, sf, "observation").select("title").where(F.col("title").isNotNull())
    sizes = {"snapshot": counted.select("source", "day").distinct().count(), "title": items.count()}
    counts = frequency.frequencies(frequency.row_blocks(counted, "snapshot").unionByName(frequency.text_blocks(items, "title", "title")))
    return frequency.marked(counts, sizes).select("scope", "term", "occurrences", "records", "mark")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_terms(spark, sf).where(F.col("mark").isNotNull()).select("scope", "term", "mark")


BEST_FIRST = [("score", True), ("acceleration_per_10k_week2", True), ("mentions", True), ("term", False)]


def p7_ranked(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """chart_date, board, the ordering columns and the rank of the best entries of each chart."""
    raw = table(spark, sf, "billboard").withColumn("term", term_key(F.col("term")))
    keep = ["score", "acceleration_per_10k_week2", "mentions"]
    counted = latest_by(raw, ["chart_date", "board", "term"], [F.col("collected_at_utc")], keep)
    return topn.top_n(counted, ["chart_date", "board"], BEST_FIRST, n)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_ranked(spark, sf).select("chart_date", "board", "term")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, piece, begin, end, tokens, label, capacity_tokens, bucket, container of every text."""
    kinds = {r.capacity_tokens: r.label for r in table(spark, sf, "containers").where(F.col("capacity_tokens") > 0).orderBy("container_id").collect()}  # the kinds of containers, a handful
    pieces = packing.sized_pieces(table(spark, sf, "documents"), ["doc_id"], max(kinds, default=1))
    placed = packing.pack(pieces, list(kinds), ["doc_id"])
    label = F.create_map(*[F.lit(x) for c, name in kinds.items() for x in (c, name)]) if kinds else F.create_map()
    return placed.withColumn("label", label[F.col("capacity")]).withColumnRenamed("capacity", "capacity_tokens")


def p8_use(spark: SparkSession, sf: str) -> DataFrame:
    """label, containers, pieces, tokens, room, unused_share by kind of container."""
    by = p8_containers(spark, sf).groupBy("label", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    out = by.groupBy("label").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum("capacity_tokens").cast("long").alias("room"))
    return out.withColumn("unused_share", F.round(1 - F.col("tokens") / F.col("room"), 6))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, item_id, matched, matched_rare, run, run_rare, begin, end of every leak."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), ["doc_id"])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, restored, pieces, unrestorable of every garbled text."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return encoding.repair(documents, encoding.fit_information(documents), ["doc_id"])


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_restored(spark, sf).select("doc_id")

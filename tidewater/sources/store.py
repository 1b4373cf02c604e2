"""The history of daily tables: idempotent writes by day, reading before a day, nested JSON documents in and out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.runtime import drop_path, folders

#: The file that names the published version.
POINTER = "CURRENT"
SNAPSHOT = "date string, schema_version int, sources map<string, struct<documents bigint, terms map<string, struct<count bigint, links array<string>>>>>, source_health array<struct<source string, status string>>"


def write_days(daily: DataFrame, path: str) -> None:
    """Write a daily table; days that are written again replace themselves and no others. Refuses an empty table."""
    if daily.isEmpty():
        raise ValueError("nothing to write: no day has rows")
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, before: date | None = None, days: int = 90) -> DataFrame:
    """The last ``days`` days that occur before a day; the bound prunes partitions, unreadable files are skipped."""
    table = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    if before is not None:
        table = table.where(F.col("day") < F.lit(before))
    kept = table.select("day").distinct().orderBy(F.desc("day")).limit(days)
    return table.join(F.broadcast(kept), "day", "left_semi")  # at most ``days`` rows


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Nested snapshot documents, one JSON object per file; malformed ones give no row."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where(F.col("date").isNotNull())


def flat_documents(snapshots: DataFrame) -> DataFrame:
    """day, source, documents."""
    return snapshots.select(F.to_date("date").alias("day"), F.explode("sources").alias("source", "s")).select("day", "source", F.col("s.documents").alias("documents"))


def flat_terms(snapshots: DataFrame) -> DataFrame:
    """day, source, term, count, links."""
    rows = snapshots.select(F.to_date("date").alias("day"), F.explode("sources").alias("source", "s")).select("day", "source", F.explode("s.terms").alias("term", "t"))
    return rows.select("day", "source", "term", F.col("t.count").alias("count"), F.col("t.links").alias("links"))


def flat_status(snapshots: DataFrame) -> DataFrame:
    """day, source, status; of several records of a source and day the last."""
    rows = snapshots.select(F.to_date("date").alias("day"), F.posexplode("source_health").alias("pos", "h"))
    return rows.groupBy("day", F.col("h.source").alias("source")).agg(F.max_by("h.status", "pos").alias("status"))


def publish_json(spark: SparkSession, table: DataFrame, path: str) -> None:
    """Publish a table as JSON lines: a version's folder is written whole, then the pointer file that names it is replaced
    by one rename, so a reader of the pointer always finds a whole version, the old or the new one. The last two stay."""
    versions = [v for v in folders(spark, path) if v.startswith("version=")]
    name = f"version={int(versions[-1].partition('=')[2]) + 1 if versions else 1:08d}"
    table.write.mode("overwrite").json(f"{path}/{name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{file}") for file in ("_next", POINTER))
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, pointer, options)
    for old in versions[:-1]:
        drop_path(spark, f"{path}/{old}")


def published_path(spark: SparkSession, path: str) -> str:
    """The folder of the version that the pointer names."""
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"

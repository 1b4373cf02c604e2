"""Session helpers: sessions for tests and benchmarks, table loading, and durable cuts of a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the library expects of any session (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, whole."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, local runs) a folder of this machine is used; a cluster master without the
    setting is refused, since a machine-local folder would lose data there.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    own = os.path.join(tempfile.gettempdir(), f"tidewater-{os.getpid()}")
    return f"file://{own}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidewater/{label}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, label: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read back, and its path: a durable cut that survives the loss of any
    executor. The path may be dropped when nothing reads it any longer, and goes with the application at the latest."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.mode("overwrite").options(**options or {}).parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """The table of :func:`written_at`."""
    return written_at(df, label)[0]


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    files, where = _files(spark, path)
    files.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path, sorted; none if there is no such path."""
    files, where = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()) if files.exists(where) else []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)

"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []


def session(app: str = "foliant", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory. Column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is local (tests) a folder of this process is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _OWN_DIRS:
        own = tempfile.mkdtemp(prefix="foliant-")
        _OWN_DIRS.append(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN_DIRS[0]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    The table outlives any executor, is written once, and keeps the row order
    and partitioning of ``df`` file by file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` once nothing reads it."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if base.removeprefix("file:").lstrip("/") in f:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "pulsewide", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local master without the setting gets a temporary folder. A cluster
    without it is an error, because a machine-local path would be lost with its
    machine; so is one whose context was given a bare local path. A setting
    with a scheme is taken as it is: a mounted share has ``file:`` too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    local = master.startswith("local") and not master.startswith("local-cluster")
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if current:
        return current
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulsewide-"))
    return spark.sparkContext.getCheckpointDir()


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pulsewide-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new path below one folder per application, so one delete removes them all."""
    return f"{_application_dir(spark)}/{uuid.uuid4().hex}"


def delete_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote for itself; tables made from it end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _landed if k[0] == spark.sparkContext.applicationId]:
        del _landed[key]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    For a result that feeds several jobs: it is computed once, a later job
    reads only the columns it needs, and a lost executor costs nothing.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_dealt(df: DataFrame, rows: int) -> DataFrame:
    """Like :func:`materialise`, for passes that keep rows in memory: no task gets more than ``rows``.

    A file holds at most so many rows and is read by a task of its own, however small it
    is. Files are packed by a setting of the session, so the table belongs to a session
    beside the caller's, with the same context.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    beside = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(key, spark.conf.get(key))
    beside.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return beside.read.schema(df.schema).parquet(path)


_landed: dict[tuple[str, str], DataFrame] = {}


def landed(name: str, build: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """A materialised table that is built once per application and then shared."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _landed:
        _landed[key] = materialise(build())
    return _landed[key]

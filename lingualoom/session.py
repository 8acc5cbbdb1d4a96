"""Session settings, and the shared folder where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The folder of each application that runs on this machine and names none.
_INVENTED: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "lingualoom") -> SparkSession:
    """A session for tests and the bench.  On a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.lingualoom.parts", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, in the parts that the scan makes of it.

    A session may ask for its rows to be dealt out (``spark.lingualoom.parts``), as the local one
    does for test tables of one row group, whose per-row work would stay in a single task.
    """
    df = spark.read.parquet(path)
    parts = spark.conf.get("spark.lingualoom.parts", None)
    return df.repartition(int(parts)) if parts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    It is only invented when the session names none and everything runs on this machine, as in
    tests; a cluster without one is a configuration error, since a machine-local folder would be
    lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _INVENTED:
        _INVENTED[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _INVENTED[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used right after an engine call, so that branches and retried tasks never repeat inference,
    and after a result that several later branches read.  The files outlive any executor.  Shuffle
    files of the write are dropped as soon as it has ended.  ``codec`` is a Parquet codec other than the session's.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.mode("errorifexists").parquet(path, compression=codec)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once everything made from them is itself written."""
    for df in staged:
        spark = df.sparkSession
        root = shared_dir(spark).rstrip("/") + "/"
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

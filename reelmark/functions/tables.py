"""Written intermediate tables: cut the lineage of a result that several steps read."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _named(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or else one below the warehouse.

    A warehouse on a local disk is only accepted where driver and executors are one process.
    """
    named = _named(spark, "spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    warehouse = _named(spark, "spark.sql.warehouse.dir") or "spark-warehouse"
    master = spark.sparkContext.master
    scheme = spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    ).getScheme()
    if scheme == "file" and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse.rstrip('/')}/scratch"


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/settled-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended before; the folder then stays
        pass


def spread(df: DataFrame, *keys: str, rows: int = 8192) -> DataFrame:
    """Deals narrow rows to tasks by ``keys``, some ``rows`` to each, where each row takes much more work than its bytes show.

    Spark sizes the tasks of a scan by bytes, so a small file whose rows grow into documents or frames is one task.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *keys)


def settle(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    Later steps then prune columns and push filters into the files, and a lost executor only
    costs the re-reading of files. With ``release`` the shuffle files of the step are removed as soon as it
    is written, where they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)

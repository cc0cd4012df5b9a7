"""Persistent tables and JSON exports.

Rows that only come in (feedback) are appended, cut by day. Rows that change by key (examples, models, runs, promotion
events, reviews) lie in buckets of the key's hash. A change writes the buckets of its keys as a new version and then a
commit, a small table of which version of each bucket holds; other buckets stay as they are. Readers take the last
complete commit, so a change is seen whole or not at all, and what a lost one has written is never read. One writer at a
time changes a table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Newest first on listing; examples oldest first.
LISTINGS = {
    "feedback": ("received_at", True, "id"),
    "training_example": ("created_at", False, "id"),
    "model": ("created_at", True, "model_id"),
    "training_run": ("created_at", True, "id"),
    "promotion_event": ("promoted_at", True, "id"),
    "review": ("reviewed_at", True, "id"),
}
DAY = "day"
KEYS = {"training_example": "id", "model": "model_id", "training_run": "id", "promotion_event": "id", "review": "id"}
# Buckets of a keyed table; fixed once it holds rows.
BUCKETS = 64


def append(df: DataFrame, root: str, name: str) -> None:
    """Adds rows; files are cut by day so that time filters prune folders."""
    column = LISTINGS[name][0]
    df.withColumn(DAY, F.substring(F.col(column).cast("string"), 1, 10)).write.mode("append").partitionBy(DAY).parquet(
        f"{root}/{name}"
    )


# ---- tables that change by key -----------------------------------------------------


def _folder(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, path: str) -> list[str]:
    system, place = _folder(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Complete commits, oldest first."""
    path = f"{root}/{name}/commits"
    named = [c for c in _children(spark, path) if c.startswith("version=")]
    return sorted(int(c.split("=")[1]) for c in named if "_SUCCESS" in _children(spark, f"{path}/{c}"))


def _commit(spark: SparkSession, root: str, name: str, version: int) -> tuple[dict[int, int], StructType]:
    """The version that holds for each bucket with rows, and the layout of the rows."""
    rows = spark.read.parquet(f"{root}/{name}/commits/version={version}").collect()  # one row per bucket
    return {r.bucket: r.holds for r in rows if r.bucket >= 0}, StructType.fromJson(json.loads(rows[0].layout))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _of_buckets(spark: SparkSession, root: str, name: str, holds: dict[int, int], layout: StructType) -> DataFrame:
    paths = [f"{root}/{name}/data/version={v}/bucket={b}" for b, v in sorted(holds.items())]
    return spark.read.schema(layout).parquet(*paths) if paths else spark.createDataFrame([], layout)


def _change(changed: DataFrame, root: str, name: str, merge) -> int:
    """Rewrites the buckets that ``changed`` (rows with ``_bucket``) touches; ``merge`` makes their new rows of the old ones."""
    spark = changed.sparkSession
    done = versions(spark, root, name)
    holds, layout = _commit(spark, root, name, done[-1]) if done else ({}, None)
    touched = {r[0] for r in changed.select("_bucket").distinct().collect()}  # at most BUCKETS numbers
    old = _of_buckets(spark, root, name, {b: v for b, v in holds.items() if b in touched}, layout) if layout else None
    rows = merge(old)
    # Numbers go on after whatever a lost change has left.
    started = [int(c.split("=")[1]) for c in _children(spark, f"{root}/{name}/data") if c.startswith("version=")]
    version = max([0, *done, *started]) + 1
    path = f"{root}/{name}/data/version={version}"
    rows.withColumn("bucket", _bucket(KEYS[name])).repartition("bucket").write.partitionBy("bucket").parquet(path)
    written = {int(c.split("=")[1]) for c in _children(spark, path) if c.startswith("bucket=")}
    holds = {**{b: v for b, v in holds.items() if b not in touched}, **dict.fromkeys(written, version)}
    listed = [(b, v, rows.schema.json()) for b, v in sorted(holds.items())] or [(-1, version, rows.schema.json())]
    commit = spark.createDataFrame(listed, "bucket int, holds bigint, layout string").coalesce(1)
    commit.write.parquet(f"{root}/{name}/commits/version={version}")
    return version


def upsert(df: DataFrame, root: str, name: str) -> int:
    """Adds rows and replaces those of the same key; returns the new version.

    Of several new rows with one key the newest by the listing's instant stays, of those the largest row.
    """
    key, column = KEYS[name], LISTINGS[name][0]
    names = [c for c in df.columns if c != key]

    def merge(old: DataFrame | None) -> DataFrame:
        rows = df.withColumn("_new", F.lit(1))
        if old is not None:
            rows = old.withColumn("_new", F.lit(0)).unionByName(rows)
        newest = F.struct("_new", column, F.to_json(F.struct(*names)))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*names), newest).alias("_row"))
        return best.select(key, "_row.*").select(*df.columns)

    return _change(df.withColumn("_bucket", _bucket(key)), root, name, merge)


def delete(keys: DataFrame, root: str, name: str) -> int:
    """Removes the rows whose key ``keys`` holds in a column of the same name; returns the new version."""
    key = KEYS[name]
    gone = keys.select(key).distinct()

    def merge(old: DataFrame | None) -> DataFrame:
        if old is None:
            raise ValueError(f"table {name} has no rows yet")
        return old.join(gone, key, "left_anti").select(*old.columns)

    return _change(gone.withColumn("_bucket", _bucket(key)), root, name, merge)


def snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a keyed table, as of a commit or the last one."""
    done = versions(spark, root, name)
    if not done or (version is not None and version not in done):
        raise ValueError(f"table {name} has no version {version or ''}".strip())
    return _of_buckets(spark, root, name, *_commit(spark, root, name, version or done[-1]))


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> None:
    """Removes commits but the last ``keep``, and versions of buckets that none of these holds."""
    done = versions(spark, root, name)
    held = {(v, b) for n in done[-keep:] for b, v in _commit(spark, root, name, n)[0].items()}
    for n in done[:-keep]:
        system, place = _folder(spark, f"{root}/{name}/commits/version={n}")
        system.delete(place, True)
    for c in _children(spark, f"{root}/{name}/data"):
        version = int(c.split("=")[1]) if c.startswith("version=") else None
        if version is None or version > done[-1]:
            continue
        for bucket in _children(spark, f"{root}/{name}/data/{c}"):
            if bucket.startswith("bucket=") and (version, int(bucket.split("=")[1])) not in held:
                system, place = _folder(spark, f"{root}/{name}/data/{c}/{bucket}")
                system.delete(place, True)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name in KEYS and _children(spark, f"{root}/{name}/commits"):
        return snapshot(spark, root, name)
    return spark.read.parquet(f"{root}/{name}").drop(DAY)


def listing(spark: SparkSession, root: str, name: str) -> DataFrame:
    column, newest_first, tie = LISTINGS[name]
    key = F.col(column).desc() if newest_first else F.col(column).asc()
    return read(spark, root, name).orderBy(key, tie)


# ---- exports -----------------------------------------------------------------------


def export_dataset(rows: DataFrame, readiness: DataFrame, generated_at: str) -> DataFrame:
    """JSON lines: first a header with schema version and readiness, then one line per dataset row."""
    head = readiness.select(
        F.to_json(
            F.struct(
                F.lit(generated_at).alias("generatedAt"),
                F.col("feature_schema_version").alias("featureSchemaVersion"),
                F.struct(*readiness.columns).alias("readiness"),
            )
        ).alias("value")
    )
    return head.unionByName(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")))


def export_model(models: DataFrame, model_id: str) -> DataFrame:
    one = models.filter(F.col("model_id") == model_id)
    return one.select(F.to_json(F.struct(*models.columns)).alias("value"))


def export_evaluation(report: DataFrame, model_id: str) -> DataFrame:
    return export_model(report, model_id)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").text(path)

"""Tables that are replaced by one commit.

Files are never changed: a build writes its own folder, then a manifest that
says, for each key (a ward, a district), which folder holds its rows and what
is known of it.  Renaming the manifest to the next number is the commit.  A
reader takes the newest manifest, so it sees the build before or the one after,
whole; two writers can't both take a number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests, in order."""
    root = _path(spark, f"{path}/manifests/n=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return sorted(int(s.getPath().getName()[2:]) for s in found)


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The keys of a manifest (the newest, if none is named) with ``build`` and what else is known; None before any commit."""
    numbers = _numbers(spark, path)
    if number is None and not numbers:
        return None
    return spark.read.parquet(f"{path}/manifests/n={numbers[-1] if number is None else number}")


def commit(rows: DataFrame, keys: DataFrame, path: str, by: list[str], order: list[str], partial: bool, folders: list[str] | None = None) -> int:
    """Replaces keys by one commit and returns its number.

    ``keys`` has a row for each key (columns ``by``) that this build replaces,
    with or without rows, and any columns that are to be known of it.  A partial
    build leaves the other keys as they are, a full one removes them.  The
    files lie in folders by ``folders`` (by the key, if not given).
    """
    spark, build, within = rows.sparkSession, uuid.uuid4().hex, folders or by
    ordered = rows.repartition(*within).sortWithinPartitions(*within, *order)
    ordered.write.partitionBy(*within).parquet(f"{path}/files/build={build}")
    numbers = _numbers(spark, path)
    entries = keys.withColumn("build", F.lit(build))
    if partial and numbers:
        before = manifest(spark, path, numbers[-1])
        kept = before.join(keys.select(*by), by, "left_anti")
        entries = kept.unionByName(entries, allowMissingColumns=True)
    number = (numbers[-1] if numbers else 0) + 1
    staged = f"{path}/manifests/.{build}"
    entries.coalesce(1).write.parquet(staged)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    plainly = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(_path(spark, staged), _path(spark, f"{path}/manifests/n={number}"), plainly)  # raises if the number is taken
    return number


def read(spark: SparkSession, path: str, schema: str, by: list[str], number: int | None = None) -> DataFrame:
    """The rows of a commit; ``schema`` has the columns that its folders are named by last.

    Rows of keys that the manifest doesn't list, or lists in another build, are
    left out by a join with it; filters on the folders' columns prune what is read.
    """
    entries = manifest(spark, path, number)
    if entries is None:
        return spark.createDataFrame([], schema)
    builds = [r[0] for r in entries.select("build").distinct().collect()]  # commits that still hold something
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{path}/files/build={b}" for b in builds if fs.exists(_path(spark, f"{path}/files/build={b}"))]
    whole = f"{schema}, build string"
    rows = spark.read.schema(whole).option("basePath", f"{path}/files").parquet(*folders)
    return rows.join(entries.select(*by, "build"), [*by, "build"], "left_semi").select(*StructType.fromDDL(schema).fieldNames())


def clean(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes manifests but the newest ``keep``, and the folders that none of those names; returns the folders' builds.

    Meant for when no writer is at work: a build that isn't committed yet is named by no manifest either.
    """
    numbers = _numbers(spark, path)
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    named: set[str] = set()
    for n in numbers[-keep:]:
        named |= {r[0] for r in manifest(spark, path, n).select("build").distinct().collect()}
    for n in numbers[:-keep]:
        fs.delete(_path(spark, f"{path}/manifests/n={n}"), True)
    gone = []
    for s in fs.globStatus(_path(spark, f"{path}/files/build=*")) or []:
        build = s.getPath().getName().split("=")[1]
        if build not in named:
            fs.delete(s.getPath(), True)
            gone.append(build)
    return gone

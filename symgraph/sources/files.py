"""Files as rows, from any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.paths import indexable, under_dir
from symgraph.sources.changes import is_repository, tracked_files


def read_files(spark: SparkSession, root: str, patterns: Sequence[str] = (), ignored: Sequence[str] = (), only: str = "", chosen: DataFrame | None = None) -> DataFrame:
    """``(path, content, modified)`` of the indexable files under ``root``, paths relative to it.

    Dot folders are left out; ``chosen(path)`` limits the files to an explicit list.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    relative = F.when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain)
    listed = found.select(relative.alias("path"), F.col("modificationTime").cast("bigint").alias("modified"), F.col("content").alias("_bytes"))
    listed = listed.where(~F.col("path").rlike(r"(?:^|/)\.[^/]") & indexable(F.col("path"), patterns, only) & ~under_dir(F.col("path"), ignored, base))
    if chosen is not None:
        listed = listed.join(chosen.select("path").distinct(), "path", "left_semi")
    return listed.select("path", F.decode("_bytes", "UTF-8").alias("content"), "modified")


def source_files(spark: SparkSession, root: str, patterns: Sequence[str] = (), ignored: Sequence[str] = (), only: str = "", paths: Sequence[str] | None = None) -> DataFrame:
    """The files to index: those listed, else those that version control tracks, else all under ``root``."""
    if paths is not None:
        chosen = spark.createDataFrame([(p,) for p in paths], "path string")
    else:
        local = root.removeprefix("file://")
        chosen = tracked_files(spark, local) if "://" not in local and is_repository(local) else None
    return read_files(spark, root, patterns, ignored, only, chosen)


def module_name(source: DataFrame, content: str = "content") -> DataFrame:
    """The module that the first line beginning ``module `` of a module file names."""
    lines = F.filter(F.transform(F.split(content, "\n"), F.trim), lambda x: x.startswith("module "))
    return source.select(F.trim(F.substr(F.try_element_at(lines, F.lit(1)), F.lit(8))).alias("module"))


def project_status(projects: DataFrame, points: DataFrame) -> DataFrame:
    """``projects`` with whether they are indexed and how many points they have, by name."""
    counted = points.groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    return projects.join(counted, "name", "left").select(*projects.columns, F.col("_n").isNotNull().alias("indexed"), F.coalesce("_n", F.lit(0)).alias("points")).orderBy("name")

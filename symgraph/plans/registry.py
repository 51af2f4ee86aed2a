"""The registry of projects, which project is meant, and the settings of an installation."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.schemas import PROJECTS

# --- registry -----------------------------------------------------------------


def find_project(projects: DataFrame, name: str) -> DataFrame:
    """The project of a name; no row if it is not registered."""
    return projects.where(F.col("name") == name).limit(1)


def find_by_path(projects: DataFrame, path: str) -> DataFrame:
    """A project registered for exactly this path, by name; registers nothing."""
    return projects.where(F.col("path") == path).orderBy("name").limit(1)


def add_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """``projects(name, path)`` after ``new`` were registered: an empty path keeps the one known."""
    both = projects.select("name", F.col("path").alias("_old")).join(new.select("name", F.col("path").alias("_new")), "name", "full")
    told = F.when(F.coalesce("_new", F.lit("")) != "", F.col("_new"))
    return both.select("name", F.coalesce(told, "_old", F.lit("")).alias("path"))


def remove_projects(projects: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names that are not registered change nothing."""
    return projects.where(~F.col("name").isin(list(names))) if names else projects


def resolve_projects(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """``(request, name, path)`` of ``requests(request, name, path, cwd)``, empty or null where not given.

    The path is the one given, else that of the named project, else the current folder. The
    name is the one given, else that of a project registered for the path, else the last part
    of the current folder.
    """
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    named = projects.select(F.col("name").alias("_name"), F.col("path").alias("_path"))
    asked = requests.join(named, F.col("name") == F.col("_name"), "left")
    asked = asked.select("request", "cwd", given("name").alias("name"), F.coalesce(given("path"), given("_path"), "cwd").alias("path"))
    placed = projects.groupBy("path").agg(F.min("name").alias("_name"))
    last = F.element_at(F.split(F.regexp_replace("cwd", "/+$", ""), "/"), -1)
    return asked.join(placed, "path", "left").select("request", F.coalesce("name", "_name", last).alias("name"), "path")


class Registry:
    """Projects in a small Parquet folder; every change writes the next version and then drops the last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._fs_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs().exists(self._fs_path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._fs_path(self.root))]
        done = [n for n in names if n.startswith("v") and self._fs().exists(self._fs_path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def projects(self) -> DataFrame:
        known = self._versions()
        return self.spark.read.schema(PROJECTS).parquet(f"{self.root}/v{known[-1]}") if known else self.spark.createDataFrame([], PROJECTS)

    def _write(self, projects: DataFrame) -> None:
        known = self._versions()
        projects.coalesce(1).write.parquet(f"{self.root}/v{(known[-1] if known else 0) + 1}")
        for v in known[:-1]:
            self._fs().delete(self._fs_path(f"{self.root}/v{v}"), True)

    def add(self, name: str, path: str) -> None:
        self._write(add_projects(self.projects(), self.spark.createDataFrame([(name, path)], PROJECTS)))

    def remove(self, name: str) -> None:
        if not find_project(self.projects(), name).isEmpty():
            self._write(remove_projects(self.projects(), [name]))

    def resolve(self, name: str = "", path: str = "", cwd: str | None = None, register: bool = True) -> tuple[str, str]:
        """The project and path that are meant, registered under that name."""
        request = [(0, name, os.path.abspath(path) if path else "", os.path.abspath(cwd or os.getcwd()))]
        row = resolve_projects(self.projects(), self.spark.createDataFrame(request, "request int, name string, path string, cwd string")).first()
        if register:
            self.add(row["name"], row["path"])
        return row["name"], row["path"]

    # --- project documents ------------------------------------------------------

    def write_readme(self, name: str, text: str) -> None:
        path = self._fs_path(f"{self.root}/readme/{name}.md")
        stream = self._fs().create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read_readme(self, name: str, most: int = 8000) -> str:
        """A project's README, cut to ``most`` code points; empty if it has none."""
        path = self._fs_path(f"{self.root}/readme/{name}.md")
        if not self._fs().exists(path):
            return ""
        stream = self._fs().open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")[:most]
        finally:
            stream.close()


# --- settings -----------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Settings with their defaults."""

    results: int = 5
    threshold: float = 0.4
    dimension: int = 4096
    max_tokens: int = 8192
    context_tokens: int = 4000
    concurrency: int = 4
    skip: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


def set_nested(tree: dict, key: str, value: object) -> dict:
    """A copy of nested ``tree`` with ``value`` at a dotted key; a plain value in the way gives way to a mapping."""
    head, _, rest = key.partition(".")
    below = tree.get(head)
    return {**tree, head: set_nested(below if isinstance(below, dict) else {}, rest, value) if rest else value}


def load_settings(text: str) -> Settings:
    """Settings from a JSON object; unknown keys stay under ``extra``."""
    found = json.loads(text) if text.strip() else {}
    names = {k for k in asdict(Settings()) if k != "extra"}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in names}
    return replace(Settings(), **own, extra={k: v for k, v in found.items() if k not in names})

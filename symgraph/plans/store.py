"""Versioned tables: immutable Parquet folders and one pointer that is flipped last.

Each table has one folder for every project and branch. A publish writes the folders that
changed, then a small JSON pointer of the next version that names the folder of every table,
project and branch. The pointer is renamed into place, so everything changes at once or not
at all, a reader keeps the version it opened, and what did not change is not written again.
Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from symgraph import schemas
from symgraph.operators.diff import delete_ids, delete_where, upsert

_TABLES = {
    "points": schemas.POINTS,
    "manifest": schemas.MANIFEST,
    "nodes": schemas.NODES,
    "edges": schemas.EDGES,
    "meta": schemas.META,
}

Home = tuple[str, str]


class Locked(RuntimeError):
    """Another writer holds the lock."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pending: dict[tuple[str, Home], DataFrame | None] = {}
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _put(self, name: str, content: dict) -> bool:
        """Write a JSON file under a name that is free; False if it is taken."""
        fs, temporary, final = self._fs(), self._path(f".{uuid.uuid4().hex}"), self._path(name)
        stream = fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            return False
        return True

    def _get(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # --- versions ---------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _folders(self, version: int) -> dict[tuple[str, Home], str]:
        if not version:
            return {}
        return {(t, (p, b)): folder for t, p, b, folder in self._get(f"versions/{version:012d}.json")["folders"]}

    def publish(self) -> int:
        """Write what is staged and make it the next version; nothing staged keeps the version."""
        if not self._pending:
            return self.version()
        base = self.version()
        folders = self._folders(base)
        for (name, home), rows in self._pending.items():
            if rows is None:
                folders.pop((name, home), None)
                continue
            folder = f"tables/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            folders[name, home] = folder
        if not self._put(f"versions/{base + 1:012d}.json", {"folders": [[t, *home, f] for (t, home), f in sorted(folders.items())]}):
            raise RuntimeError(f"version {base + 1} was published by another writer")
        self._pending = {}
        return base + 1

    def rollback(self) -> None:
        self._pending = {}

    def expire(self, keep: int = 1) -> int:
        """Remove all but the last ``keep`` versions and the folders that only they name."""
        known = self.versions()
        kept = {f for v in known[-keep:] for f in self._folders(v).values()}
        gone = {f for v in known[:-keep] for f in self._folders(v).values()} - kept
        for name in (*sorted(gone), *(f"versions/{v:012d}.json" for v in known[:-keep])):
            self._fs().delete(self._path(name), True)
        return len(gone)

    # --- reading ----------------------------------------------------------------

    def homes(self, name: str = "manifest", version: int | None = None) -> list[Home]:
        """The projects and branches that a table has, as last published."""
        return sorted(h for t, h in self._folders(self.version() if version is None else version) if t == name)

    def exists(self, project: str, branch: str | None = None) -> bool:
        """Whether a project, or a branch of it, is indexed."""
        return any(p == project and branch in (None, b) for p, b in self.homes())

    def table(self, name: str, project: str | None = None, branch: str | None = None, version: int | None = None) -> DataFrame:
        """A table as last published (or pending here), of a project and branch or of all."""
        schema = _TABLES[name]
        wanted = lambda home: project in (None, home[0]) and branch in (None, home[1])
        folders = {h: f for (t, h), f in self._folders(self.version() if version is None else version).items() if t == name and wanted(h)}
        staged = {h: rows for (t, h), rows in self._pending.items() if t == name and wanted(h)} if version is None else {}
        paths = [f"{self.root}/{f}" for h, f in sorted(folders.items()) if h not in staged]
        out = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        for rows in staged.values():
            out = out if rows is None else out.unionByName(rows)
        return out

    def count(self, project: str) -> int:
        """Points of a project; none if it is not indexed."""
        return self.table("points", project).count()

    def meta(self, project: str, branch: str, key: str, default: str | None = None) -> str | None:
        row = self.table("meta", project, branch).where(f"key = '{key}'").select("value").first()
        return default if row is None else row["value"]

    # --- staging ----------------------------------------------------------------

    def replace(self, name: str, project: str, branch: str, rows: DataFrame) -> None:
        """Stage the whole of a table's project and branch for the next publish."""
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        self._pending[name, (project, branch)] = rows.select(*columns)

    def upsert(self, name: str, project: str, branch: str, rows: DataFrame) -> None:
        key = schemas.KEYS[name]
        self.replace(name, project, branch, upsert(self.table(name, project, branch), rows.dropDuplicates(list(key)), key))

    def delete_ids(self, name: str, project: str, branch: str, ids: DataFrame, key: str) -> None:
        self.replace(name, project, branch, delete_ids(self.table(name, project, branch), ids, key))

    def delete_where(self, name: str, project: str, branch: str, **equal: object) -> None:
        self.replace(name, project, branch, delete_where(self.table(name, project, branch), **equal))

    def drop_branch(self, project: str, branch: str | None = None) -> None:
        """Stage the removal of a branch, or of a whole project, from every table; nothing is rewritten."""
        for name, home in {*self._folders(self.version()), *self._pending}:
            if home[0] == project and branch in (None, home[1]):
                self._pending[name, home] = None

    def drop_all(self) -> None:
        for project in {p for _, (p, _) in self._folders(self.version())}:
            self.drop_branch(project)

    def set_meta(self, project: str, branch: str, **values: object) -> None:
        rows = [(project, branch, k, str(v)) for k, v in values.items()]
        self.upsert("meta", project, branch, self.spark.createDataFrame(rows, schemas.META))

    # --- one writer -------------------------------------------------------------

    @contextmanager
    def lock(self, project: str, wait: float = 4.0, poll: float = 0.1, stale: float = 3600.0) -> Iterator[None]:
        """Hold a project's writer lock; ``Locked`` if another writer keeps it for ``wait`` seconds.

        A lock older than ``stale`` seconds was left by a writer that died, and is taken over.
        """
        name = f"locks/{uuid.uuid5(uuid.NAMESPACE_URL, project).hex}.json"
        until = time.monotonic() + wait
        while not self._put(name, {"project": project}):
            fs, path = self._fs(), self._path(name)
            if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale:
                fs.delete(path, False)
            elif time.monotonic() > until:
                raise Locked(project)
            else:
                time.sleep(poll)
        try:
            yield
        finally:
            self._fs().delete(self._path(name), False)

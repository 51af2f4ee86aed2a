"""Sharding: a store of immutable files under size-tiered compaction and a versioned manifest.

``append`` writes arrivals as small immutable shards. ``compact`` groups runs of similar size
(a tier is a factor of ``ratio``) and merges the runs of a tier that has ``fan_in`` of them
into files of the target size. Every change is a new version of the manifest, a small JSON
file that is written under a temporary name and then renamed to its version; the rename
fails if another writer took that version, and the change is tried again on what is current.
Readers see the files of one version. Files that no kept version names are removed by
``expire``.

Paths go through Hadoop's file systems, so a store can be anywhere that Spark writes.
Rows are moved by Spark only; the driver sees file names and sizes. A merge reads its runs
in splits of the target size, small files packed together and large ones cut between row
groups, and writes a file for each split: no shuffle, and no file above the target by more
than a row group.

Defined cases: an empty arrival adds nothing. Nulls, repeated rows and all columns are kept
as they are; the first arrival fixes the schema, and an arrival with other columns is
refused. A store without versions reads as no rows of the given schema.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Run:
    """The files of one append or merge."""

    files: tuple[str, ...]
    size: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    runs: tuple[Run, ...]


class ConcurrentCommit(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, ratio: int = 4, floor_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.ratio, self.floor_bytes = target_bytes, fan_in, ratio, floor_bytes
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, by default the last; none before the first commit."""
        known = self.versions()
        if version is None and not known:
            return None
        number = known[-1] if version is None else version
        stream = self._fs().open(self._path(f"manifests/v{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        spec = json.loads(text)
        return Manifest(spec["version"], spec["schema"], tuple(Run(tuple(r["files"]), r["size"]) for r in spec["runs"]))

    def _commit(self, schema: str, runs: tuple[Run, ...], base: int) -> Manifest:
        """Version ``base + 1``, unless another writer has taken it."""
        made = Manifest(base + 1, schema, runs)
        fs, final = self._fs(), self._path(f"manifests/v{made.version:012d}.json")
        temporary = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(asdict(made)).encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise ConcurrentCommit(f"version {made.version} is taken")
        return made

    def _change(self, change, tries: int = 5) -> Manifest:
        """Commit ``change(current manifest)``, again on the newer manifest if that was overtaken."""
        for left in reversed(range(tries)):
            now = self.manifest()
            made = change(now)
            if made is None:
                return now
            try:
                return self._commit(*made, now.version if now else 0)
            except ConcurrentCommit:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def _write(self, df: DataFrame) -> Run:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        found = [s for s in self._fs().listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return Run(tuple(sorted(f"{folder}/{s.getPath().getName()}" for s in found)), sum(s.getLen() for s in found))

    def append(self, arrival: DataFrame) -> Manifest | None:
        """``arrival`` as a run of immutable shards, one for each of its partitions."""
        schema = arrival.schema.json()
        now = self.manifest()
        if now and _names(now.schema) != _names(schema):
            raise ValueError("the arrival's columns are not the store's")
        if arrival.isEmpty():
            return now
        run = self._write(arrival)
        return self._change(lambda m: (m.schema if m else schema, (*(m.runs if m else ()), run)))

    def tier(self, size: int) -> int:
        """The power of ``ratio`` that a run's size is in; all runs under the floor are in tier 0."""
        tier, bound = 0, self.floor_bytes
        while size > bound:
            tier, bound = tier + 1, bound * self.ratio
        return tier

    def _due(self, runs: tuple[Run, ...]) -> tuple[Run, ...]:
        """The runs of the lowest tier that has ``fan_in`` of them."""
        tiers: dict[int, list[Run]] = {}
        for run in runs:
            tiers.setdefault(self.tier(run.size), []).append(run)
        return next((tuple(t) for _, t in sorted(tiers.items()) if len(t) >= self.fan_in), ())

    def compact(self) -> Manifest | None:
        """Merge due tiers until none is due; each merge is a version of its own."""
        now = self.manifest()
        while now and (due := self._due(now.runs)):
            merged = self._write(self._frame(due, now.schema, self._splits()))

            def swap(m: Manifest, due=due, merged=merged):
                if not set(due) <= set(m.runs):
                    return None  # another writer merged some of them; what was written here stays unnamed
                return m.schema, (*(r for r in m.runs if r not in due), merged)

            after = self._change(swap)
            if after.version == now.version:
                break
            now = after
        return now

    def expire(self, keep: int = 1) -> int:
        """Remove all but the last ``keep`` versions and the files that only they name."""
        known = self.versions()
        kept = {f for v in known[-keep:] for r in self.manifest(v).runs for f in r.files}
        gone = {f for v in known[:-keep] for r in self.manifest(v).runs for f in r.files} - kept
        for f in gone:
            self._fs().delete(self._path(f), False)
        for v in known[:-keep]:
            self._fs().delete(self._path(f"manifests/v{v:012d}.json"), False)
        return len(gone)

    def _splits(self) -> SparkSession:
        """A session of the same application that reads files in splits of the target size."""
        session = self.spark.newSession()
        for name, value in (("maxPartitionBytes", self.target_bytes), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{name}", str(value))
        return session

    def _frame(self, runs: tuple[Run, ...], schema: str, session: SparkSession | None = None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        paths = [f"{self.root}/{f}" for r in runs for f in r.files]
        return (session or self.spark).read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        now = self.manifest(version)
        if now is None:
            raise LookupError("the store has no version")
        return self._frame(now.runs, now.schema)


def _names(schema: str) -> list[tuple[str, str]]:
    return sorted((f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(schema)).fields)

"""Snapshot against manifest: what is dirty, stale, orphaned or missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_symbols(symbols: DataFrame, manifest: DataFrame, key: Sequence[str] = ("file", "symbol"), hash_: str = "content_hash") -> DataFrame:
    """Symbols without a manifest row, or with one whose ``embedded_hash`` differs.

    The manifest is reduced to one row for each symbol (its least and greatest hash) before
    the join, so the join sees each key once.
    """
    held = manifest.groupBy(*key).agg(F.min("embedded_hash").alias("_low"), F.max("embedded_hash").alias("_high"), F.count("embedded_hash").alias("_known"), F.count(F.lit(1)).alias("_rows"))
    joined = symbols.join(held, list(key), "left")
    same = (F.col("_low") == F.col(hash_)) & (F.col("_high") == F.col(hash_)) & (F.col("_known") == F.col("_rows"))
    return joined.where(~F.coalesce(same, F.lit(False))).drop("_low", "_high", "_known", "_rows")


def stale_rows(manifest: DataFrame, symbols: DataFrame, deleted: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """Manifest rows of symbols that a parsed file no longer has, and of deleted files.

    ``parsed(file)`` limits the first part to files that were parsed (all, if not given).
    """
    rows = manifest if parsed is None else manifest.join(parsed.select("file").distinct(), "file", "left_semi")
    gone = rows.join(symbols.select("file", "symbol").distinct(), ["file", "symbol"], "left_anti")
    if deleted is None:
        return gone
    return gone.unionByName(manifest.join(deleted.select("file").distinct(), "file", "left_semi")).dropDuplicates(["file", "symbol", "chunk_id"])


def orphan_chunks(old: DataFrame, new: DataFrame, key: Sequence[str] = ("file", "symbol")) -> DataFrame:
    """Chunk ids of re-embedded symbols (those in ``new``) that are not among their new ones."""
    return old.join(new.select(*key).distinct(), list(key), "left_semi").join(new.select(*key, "chunk_id"), [*key, "chunk_id"], "left_anti")


def missing(symbols: DataFrame, points: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Symbols whose first chunk is not stored."""
    return symbols.join(points.select(key), key, "left_anti")


def changed_since(files: DataFrame, last_sync: int, modified: str = "modified") -> DataFrame:
    """Files modified after the last sync; all of them before the first."""
    return files if last_sync == 0 else files.where(F.col(modified) > last_sync)


def removed_files(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Files of the manifest that were not seen."""
    return manifest.select("file").distinct().join(seen.select("file").distinct(), "file", "left_anti")


def change_set(*parts: DataFrame) -> DataFrame:
    """``(path, op)`` of several change lists, each path once; a deletion wins over a change."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("path").agg(F.min(F.when(F.col("op") == "deleted", "deleted").otherwise("~changed")).alias("op")).select("path", F.ltrim("op", F.lit("~")).alias("op"))


def last_by_file(points: DataFrame) -> DataFrame:
    """Points collapsed to one for each id, the last by file: how an id without the file in it behaves."""
    return points.groupBy("chunk_id").agg(F.max_by(F.struct(*points.columns), F.struct("file_path", "chunk_number")).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` and the rows of ``old`` under other keys."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def delete_ids(old: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def delete_where(old: DataFrame, **equal: object) -> DataFrame:
    """``old`` less the rows that meet all equalities; no equality deletes nothing."""
    if not equal:
        return old
    met = F.lit(True)
    for name, value in equal.items():
        met = met & F.col(name).eqNullSafe(F.lit(value))
    return old.where(~met)

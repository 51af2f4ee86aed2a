"""Change lists from version control's text output, and commits to replay."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPS = "array<struct<path:string,op:string>>"


def _change(path, op: str):
    return F.struct(path.alias("path"), F.lit(op).alias("op"))


def _unquoted(path):
    return F.btrim(F.trim(path), F.lit('"'))


def parse_porcelain(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(path, op)`` of status lines: two code characters, a blank, a path.

    A rename deletes the old path and changes the new one; a ``D`` in either code deletes;
    anything else changes. Lines of fewer than four characters say nothing.
    """
    text = F.col(line)
    code, rest = F.substring(text, 1, 2), F.substr(text, F.lit(4))
    sides = F.split(rest, " -> ", 2)
    moved = F.array(_change(_unquoted(sides[0]), "deleted"), _change(_unquoted(F.get(sides, F.lit(1))), "changed"))
    ops = F.when(F.size(sides) > 1, moved).when(code.contains("D"), F.array(_change(_unquoted(rest), "deleted"))).otherwise(F.array(_change(_unquoted(rest), "changed")))
    return lines.where(F.length(text) >= 4).select(F.explode(ops.cast(_OPS)).alias("_c")).select("_c.*")


def parse_name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(path, op)`` of range-diff lines: a status and one or two paths, by white space."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    moved = F.array(_change(second, "deleted"), _change(third, "changed"))
    ops = (
        F.when(parts[0].startswith("D"), F.array(_change(second, "deleted")))
        .when(parts[0].startswith("R") & (F.size(parts) >= 3), moved)
        .otherwise(F.array(_change(second, "changed")))
    )
    return lines.where(F.size(parts) >= 2).select(F.explode(ops.cast(_OPS)).alias("_c")).select("_c.*")


def replay_commits(commits: DataFrame, touched: DataFrame, since, statuses: str = "ACMRT") -> DataFrame:
    """``(path, first_commit)``: files that commits since a moment touched (not deleted), first commit first.

    ``commits(commit, ts)`` and ``touched(commit, path, status)``.
    """
    chosen = commits.where(F.col("ts") >= since).select("commit")
    kept = touched.where(F.col("status").isin(list(statuses)))
    return kept.join(chosen, "commit").groupBy("path").agg(F.min("commit").alias("first_commit"))


def last_commit_times(files: DataFrame, commits: DataFrame, touched: DataFrame, now: int) -> DataFrame:
    """``files(path)`` with ``last_modified``, the time of the last commit that touched them, else now."""
    last = touched.join(commits, "commit").groupBy("path").agg(F.max("ts").alias("_ts"))
    return files.join(last, "path", "left").withColumn("last_modified", F.coalesce("_ts", F.lit(now))).drop("_ts")


def gone_branches(lines: DataFrame, line: str = "line") -> DataFrame:
    """Branches whose upstream is gone, from verbose branch lines."""
    text = F.regexp_replace(F.trim(F.col(line)), r"^\* ", "")
    return lines.where(F.col(line).contains(": gone]")).select(F.regexp_extract(text, r"^\s*(\S+)", 1).alias("branch"))


def _git(repository: str, *arguments: str) -> str | None:
    """A git command's output; None if it fails or there is no git."""
    try:
        done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, check=False)
    except OSError:
        return None
    return None if done.returncode else done.stdout


def git_lines(spark: SparkSession, repository: str, *arguments: str) -> DataFrame:
    """``(ord, line)``: the non-blank output lines of a git command; none if it fails."""
    rows = [(i, x) for i, x in enumerate((_git(repository, *arguments) or "").splitlines()) if x.strip()]
    return spark.createDataFrame(rows, "ord int, line string")


def is_repository(path: str) -> bool:
    return (_git(path, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def current_branch(repository: str) -> str:
    """The branch checked out; empty where none is."""
    name = (_git(repository, "rev-parse", "--abbrev-ref", "HEAD") or "").strip()
    return "" if name == "HEAD" else name


def head_commit(repository: str) -> str:
    return (_git(repository, "rev-parse", "HEAD") or "").strip()


def tracked_files(spark: SparkSession, repository: str) -> DataFrame:
    return git_lines(spark, repository, "ls-files").select(F.col("line").alias("path"))


def branch_candidates(spark: SparkSession, repository: str, branch: str) -> DataFrame:
    """``(candidate, merge_base, base_ts, ahead)`` of every other local branch that shares history."""
    run = lambda *a: (_git(repository, *a) or "").strip()
    rows = []
    for name in run("for-each-ref", "--format=%(refname:short)", "refs/heads").splitlines():
        base = run("merge-base", name, branch) if name != branch else ""
        if base:
            rows.append((name, base, int(run("show", "-s", "--format=%ct", base) or 0), int(run("rev-list", "--count", f"{base}..{name}") or 0)))
    return spark.createDataFrame(rows, "candidate string, merge_base string, base_ts bigint, ahead int")

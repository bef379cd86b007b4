"""Changes from git: commits, changed files, and what a sync has to look at. The command runs on the driver; its output is a table."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_BYTES = 1 << 20


class OrphanedCheckpoint(Exception):
    """The commit of the last sync is no longer there: a full sync is needed."""


def _git(repo: str, *args: str) -> str | None:
    """Output of a command, or None if it fails."""
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def version() -> str | None:
    return (_git(".", "--version") or "").strip() or None


def head(repo: str) -> str | None:
    """The commit that is checked out."""
    out = _git(repo, "rev-parse", "HEAD")
    return out.strip() if out else None


def exists(repo: str, commit: str) -> bool:
    return _git(repo, "cat-file", "-e", f"{commit}^{{commit}}") is not None


def between(repo: str, start: str, end: str) -> list[str] | None:
    """Paths that changed from one commit to another; None if git fails."""
    out = _git(repo, "-c", "core.quotePath=false", "diff", "--name-only", f"{start}..{end}")
    return None if out is None else [p for p in out.split("\n") if p]


def tracked(repo: str, commit: str) -> list[str] | None:
    """All paths of a commit; None if git fails."""
    out = _git(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "--name-only", commit)
    return None if out is None else [p for p in out.split("\n") if p]


def diff(spark: SparkSession, repo: str, since: str) -> DataFrame | None:
    """``path`` of the files that changed from a commit to the one checked out; None if git fails, no rows if nothing changed."""
    out = _git(repo, "-c", "core.quotePath=false", "diff", "--name-only", f"{since}..HEAD")
    return None if out is None else spark.createDataFrame([(p,) for p in out.split("\n") if p], "path string")


def log(spark: SparkSession, repo: str, start: str | None = None, since: str | None = None, most: int | None = None) -> DataFrame:
    """``ord, commit, subject, status, path`` of commits and what they changed, newest first: from a commit on, since a date, or the last few.

    More than a megabyte of output counts as a failure, and a failure as no commits.
    """
    args = [f"{start}..HEAD"] if start else [f"--since={since}"] if since else [f"--max-count={most}"] if most is not None else []
    out = _git(repo, "-c", "core.quotePath=false", "--no-pager", "log", "--name-status", "--oneline", *args) or ""
    rows, commit, subject = [], None, None
    for line in out.split("\n") if len(out.encode()) <= LOG_BYTES else []:
        if "\t" in line:
            status, *paths = line.split("\t")
            rows.append((len(rows), commit, subject, status, paths[-1]))
        elif line:
            commit, _, subject = line.partition(" ")
            rows.append((len(rows), commit, subject, None, None))
    return spark.createDataFrame(rows, "ord int, commit string, subject string, status string, path string")


def changes(spark: SparkSession, repo: str, last_commit: str | None, include, events: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame | None:
    """``path`` of what a sync has to look at: the events' files, else the diff since the last sync, else all files.

    ``include`` makes a condition from a path column. None means that git failed for now: try again later. A last
    commit that is gone raises ``OrphanedCheckpoint``.
    """
    if events is not None:
        return events.where(include(F.col("path"))).select("path").distinct()
    if last_commit:
        if not exists(repo, last_commit):
            raise OrphanedCheckpoint(last_commit)
        changed = diff(spark, repo, last_commit)
        return None if changed is None else changed.where(include(F.col("path")))
    return files.select("path")

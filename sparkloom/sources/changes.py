"""A streaming source of changed files: one offset for each repository, its commit."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import git

NAME = "repository_changes"
SCHEMA = "repo string, path string, commit string, at timestamp"


@dataclass
class Range(InputPartition):
    """The commits of one repository that a batch covers; a null start stands for all files."""

    repo: str
    folder: str
    start: str | None
    end: str

    def __post_init__(self):
        super().__init__(self.repo)


class ChangeReader(DataSourceStreamReader):
    """Batches from one checked-out commit to the next.

    A restarted query goes on from the commits in its checkpoint, so it repeats and loses nothing. A commit that the repository no longer has
    ends the query with ``OrphanedCheckpoint``; a git that fails for now, or a folder without a commit, leaves the offset where it is, and the next
    trigger tries again. A commit without changed files moves the offset and gives no rows.
    """

    def __init__(self, options: dict):
        self.repos: dict[str, str] = json.loads(options["repos"])
        self.since: dict[str, str] = json.loads(options.get("since", "{}"))
        self.ignore = set(json.loads(options.get("ignore", "[]")))
        self.at: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {repo: self.since.get(repo, "") for repo in self.repos}

    def latestOffset(self) -> dict:
        for repo, folder in self.repos.items():
            self.at[repo] = git.head(folder) or self.at.get(repo, "")
        return {repo: self.at.get(repo, "") for repo in self.repos}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for repo, folder in self.repos.items():
            old, new = start.get(repo) or None, end.get(repo) or None
            if new is None or new == old:
                continue
            if old and not git.exists(folder, old):
                raise git.OrphanedCheckpoint(old)
            out.append(Range(repo, folder, old, new))
        return out

    def read(self, partition: Range):
        paths = git.tracked(partition.folder, partition.end) if partition.start is None else git.between(partition.folder, partition.start, partition.end)
        if paths is None:
            raise RuntimeError(f"git failed in {partition.folder}")  # the task, and then the batch, is tried again
        now = datetime.now(UTC).replace(tzinfo=None)
        for path in paths:
            path = path.replace("\\", "/").removeprefix("./")
            if path and path not in self.ignore:
                yield partition.repo, path, partition.end, now


class ChangeSource(DataSource):
    """``spark.readStream.format("repository_changes")`` with the option ``repos``, a JSON object of folders by name.

    ``since`` holds the commits that are already indexed, ``ignore`` a list of paths that are the engine's own, such as its state file.
    Every task must be able to read the folders.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def changes(spark: SparkSession, repos: dict[str, str], since: dict[str, str] | None = None, ignore: list[str] | None = None):
    """A stream ``repo, path, commit, at`` of what commits change in some repositories."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(NAME).option("repos", json.dumps(repos)).option("since", json.dumps(since or {})).option("ignore", json.dumps(ignore or [])).load()

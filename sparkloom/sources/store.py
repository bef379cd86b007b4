"""Tables of an engine: parts that are only ever added, and a pointer file for each version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string


class VersionTaken(RuntimeError):
    """Another writer committed the version that this one was about to; nothing of this write is in the table."""


class Table:
    """Rows under a folder, told apart by ``keys`` and laid out by the first of them.

    A write adds one part of new rows and one of the keys that they replace, each in a folder of its own name, and then
    renames a pointer file into place that lists all parts of the next version. Nothing is ever overwritten: readers see one version or
    the next, a crash in between leaves the last one, and of two writers that began at one version the second finds the
    pointer's name taken and raises ``VersionTaken``; its parts are in no version. The file system must have renames that fail where the name
    exists, as HDFS does. Rows that later parts replace are left out on reading until ``compact`` writes one part of what is left.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema: StructType = _parse_datatype_string(schema)

    def _files(self):
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(f"{self.path}/versions")
        return fs, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict | None:
        """What the last version consists of: the names are listed, and one file is read."""
        _, folder, files = self._files()
        if not files.exists(folder):
            return None
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        names = [n for n in names if n.isdigit()]
        return json.loads(self.spark.read.text(f"{self.path}/versions/{max(names)}", wholetext=True).first().value) if names else None

    def _claim(self, version: int, content: dict) -> None:
        fs, folder, files = self._files()
        made = fs.Path(folder, f"_{uuid.uuid4().hex}")
        files.mkdirs(folder)
        out = files.create(made, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        context = fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(made), files.makeQualified(fs.Path(folder, f"{version:012d}")), plain)
        except Py4JJavaError as error:
            files.delete(made, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise VersionTaken(f"version {version} of {self.path} exists: another writer committed it") from None
            raise

    def _parts(self, kind: str, names: list[str], schema: StructType) -> DataFrame:
        full = StructType(schema.fields[:]).add("v", StringType())
        found = self.spark.read.schema(full).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/v={n}" for n in names])
        return found.withColumn("v", F.substring_index("v", "-", 1).cast("long"))

    def read(self, where: Column | None = None) -> DataFrame:
        """The rows of the last version."""
        now = self.pointer()
        if not now or not now["rows"]:
            empty = self.spark.createDataFrame([], self.schema)
            return empty if where is None else empty.where(where)
        rows = self._parts("rows", now["rows"], self.schema)
        rows = rows if where is None else rows.where(where)
        if now["gone"]:
            gone = self._parts("gone", now["gone"], StructType([self.schema[k] for k in self.keys]))
            gone = gone.groupBy(*self.keys).agg(F.max("v").alias("__gone"))
            rows = rows.join(gone, self.keys, "left").where("__gone is null or v >= __gone")
        return rows.select(*self.schema.names)

    def _commit(self, rows: DataFrame | None, gone: DataFrame | None, before: dict | None, fresh: bool = False, info: Callable[[DataFrame], dict] | None = None) -> None:
        now = before or {"version": 0, "rows": [], "gone": [], "info": {}}
        n = now["version"] + 1
        new = {"version": n, "rows": [] if fresh else [*now["rows"]], "gone": [] if fresh else [*now["gone"]], "info": dict(now.get("info", {}))}
        name = f"{n}-{uuid.uuid4().hex}"
        for kind, part in (("rows", rows), ("gone", gone)):
            if part is not None:
                layout = [self.keys[0]] if kind == "rows" else []
                part.write.partitionBy(*layout).parquet(f"{self.path}/{kind}/v={name}")
                new[kind].append(name)
        if rows is not None and info:
            new["info"] |= info(self._parts("rows", [name], self.schema))
        self._claim(n, new)

    def info(self) -> dict:
        """What writes noted about the table."""
        return (self.pointer() or {}).get("info", {})

    def put(self, rows: DataFrame, info: Callable[[DataFrame], dict] | None = None) -> None:
        """Add rows; those of equal keys are replaced. ``rows`` holds each key once. ``info`` makes notes from the new part alone."""
        before = self.pointer()
        rows = rows.select(*self.schema.names)
        known = before and before["rows"]
        self._commit(rows, rows.select(*self.keys) if known else None, before, info=info)

    def remove(self, keys: DataFrame) -> None:
        """Leave out the rows of some keys; unknown ones do nothing."""
        before = self.pointer()
        if before and before["rows"]:
            self._commit(None, keys.select(*self.keys).distinct(), before)

    def compact(self) -> None:
        """One part of what is left; older versions stay readable by their parts."""
        before = self.pointer()
        if before:
            self._commit(self.read(), None, before, fresh=True)


def same_keys(keys: list[str], row: dict) -> Column:
    """Whether a row's keys are those of ``row``."""
    return reduce(lambda a, b: a & b, [F.col(k) == row[k] for k in keys])

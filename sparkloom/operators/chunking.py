"""Splitting file contents into header-tagged chunks, and interval arithmetic on spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 2000
_BLANK = re.compile(r"\n{2,}")
_WHITE = "﻿"


def _strip(text: str) -> str:
    return text.strip().strip(_WHITE).strip()


def chunk_text(header: str, content: str, max_chars: int = MAX_CHARS) -> Iterator[str]:
    """Pack a content's paragraphs under a header, each chunk of ``max_chars`` at most.

    A paragraph that does not fit starts a new chunk; one that fits no chunk is cut hard. Chunks after
    the first have their header marked as continued. Blank contents give none.
    """
    if not _strip(content):
        return
    room = max_chars - len(header) - 2
    parts: list[str] = []
    used = 0
    first = True
    for section in _BLANK.split(content):
        while section:
            if parts and used + len(section) > room:
                yield _strip(header + "\n\n" + "".join(parts))
                if first:
                    header, room, first = header + " (continued)", room - len(" (continued)"), False
                parts, used = [], 0
                continue
            left = room - used
            if left <= 0:
                raise ValueError(f"the header leaves no room within {max_chars} characters")
            if len(section) <= left:
                parts += [section, "\n\n"]
                used += len(section) + 2
                break
            parts.append(section[:left])
            section = section[left:]
            yield _strip(header + "\n\n" + "".join(parts))
            if first:
                header, room, first = header + " (continued)", room - len(" (continued)"), False
            parts, used = [], 0
    if parts:
        yield _strip(header + "\n\n" + "".join(parts))


def chunks(files: DataFrame, max_chars: int = MAX_CHARS, header: str | None = None) -> DataFrame:
    """``source_path, chunk_no, text`` of ``path, content`` and, if named, a column with the header."""
    head = F.concat(F.lit("FILE: "), "path") if header is None else F.col(header)
    rows = files.select("path", head.alias("header"), F.coalesce("content", F.lit("")).alias("content"))

    def run(batches):
        for batch in batches:
            paths, numbers, texts = [], [], []
            for path, top, content in zip(*(batch.column(c).to_pylist() for c in ("path", "header", "content")), strict=True):
                for i, text in enumerate(chunk_text(top, content, max_chars)):
                    paths.append(path)
                    numbers.append(i)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["source_path", "chunk_no", "text"])

    return rows.mapInArrow(run, "source_path string, chunk_no int, text string")


def plain_chunks(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The chunks of contents without blank lines, by arithmetic alone; others need ``chunks``."""
    head = F.concat(F.lit("FILE: "), "path")
    rows = files.where("content rlike '\\\\S'").select("path", head.alias("h"), "content", F.length("content").alias("n"))
    rows = rows.withColumn("a", F.lit(max_chars) - F.length("h") - 2).withColumn("b", F.col("a") - 12)
    more = F.ceil(F.greatest(F.col("n") - F.col("a"), F.lit(0)) / F.col("b")).cast("int")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), more)).alias("chunk_no"))
    start = F.when(F.col("chunk_no") == 0, 0).otherwise(F.col("a") + (F.col("chunk_no") - 1) * F.col("b"))
    size = F.when(F.col("chunk_no") == 0, F.col("a")).otherwise(F.col("b"))
    top = F.when(F.col("chunk_no") == 0, F.col("h")).otherwise(F.concat("h", F.lit(" (continued)")))
    text = F.concat(top, F.lit("\n\n"), F.substring("content", start + 1, size))
    return each.select(F.col("path").alias("source_path"), "chunk_no", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def merge_intervals(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans of each group merged where they overlap or touch."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.coalesce(reach < F.col(start), F.lit(True))).cast("int")
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.select(*by, start, end).withColumn("__new", new).withColumn("__island", island)
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def gaps(merged: DataFrame, lengths: DataFrame, by: list[str], length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    """What merged spans leave of [0, length) in each group of ``lengths``."""
    order = Window.partitionBy(*by).orderBy("__s", "__e")
    ends = lengths.select(*by, F.col(length).alias("__s"), F.col(length).alias("__e"))
    both = merged.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e")).join(lengths.select(*by), by, "left_semi").unionByName(ends)
    out = both.select(*by, F.coalesce(F.lag("__e").over(order), F.lit(0)).alias(start), F.col("__s").alias(end))
    return out.where(F.col(start) < F.col(end))


def file_contexts(refs: DataFrame, max_chars: int = 300, names: int = 24) -> DataFrame:
    """``path, context``: what a file imports and exports on one line.

    ``refs`` has ``path, kind`` ('import' or 'export'), ``module`` and ``names`` as array of
    ``struct<local, name>``; a default or whole-module import counts by its local name.
    """
    from ..functions.text import module_basename

    imported = F.transform("names", lambda n: F.when(n["name"].isin("default", "*"), n["local"]).otherwise(n["name"]))
    exported = F.filter(F.transform("names", lambda n: n["name"]), lambda n: n != "*")
    one = refs.where("kind in ('import', 'export')").select(
        "path", "kind", F.when(F.col("kind") == "import", F.concat(F.array(module_basename("module")), imported)).otherwise(exported).alias("n")
    )
    # one shuffle: every later step groups by the path, or by the path and more
    word = one.repartition("path").select("path", "kind", F.explode("n").alias("name")).where("name <> ''").distinct()
    rank = F.row_number().over(Window.partitionBy("path", "kind").orderBy(F.collate("name", "UNICODE"), "name"))
    top = word.withColumn("r", rank).where(F.col("r") <= names)
    ranked = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("r", "name"))))
    lists = top.groupBy("path").agg(*[F.transform(ranked(k), lambda x: x["name"]).alias(k) for k in ("import", "export")])
    part = lambda k: F.when(F.size(k) > 0, F.concat(F.lit(f"{k}s: "), F.array_join(k, ", ")))
    line = F.concat(F.lit("CONTEXT | "), F.concat_ws(" | ", part("import"), part("export")))
    return lists.select("path", F.left(line, F.lit(max_chars)).alias("context"))

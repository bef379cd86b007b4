"""Line-wise operators: regex search, glob listing, line windows, grounding of file references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import glob_regex, include_file

PER_FILE, GREP_CHARS, GLOB_FILES, READ_CHARS, READ_LINES = 50, 32_000, 200, 16_000, 400


def grep(files: DataFrame, pattern: str, glob: str | None = None, ignore_case: bool = False, per_file: int = PER_FILE) -> DataFrame:
    """``path, line, text`` of matching lines, the first ``per_file`` of each file."""
    if not pattern:
        raise ValueError("an empty pattern")
    found = files if glob is None else files.where(F.col("path").rlike(glob_regex(glob)))
    rx = ("(?i)" if ignore_case else "") + pattern
    hits = F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: x["text"].rlike(rx))
    # the search of a file stays in its row
    return found.where(F.col("content").rlike(("(?m)" if rx[:4] != "(?i)" else "(?im)") + pattern)).select("path", F.explode(F.slice(hits, 1, per_file)).alias("h")).select("path", "h.line", "h.text")


def within_chars(hits: DataFrame, most: int = GREP_CHARS) -> DataFrame:
    """``path, line, text, truncated`` of a search's hits in order, as many as fit in ``most`` characters of "path:line:text" lines.

    It is a report for a reader: only as many lines as can fit are looked at.
    """
    first = hits.orderBy("path", "line").limit(most + 1)
    size = F.length("path") + F.length(F.col("line").cast("string")) + F.length("text") + 3
    upto = F.sum(size).over(Window.orderBy("path", "line"))
    marked = first.withColumn("__fits", upto - 1 <= most)
    return marked.withColumn("truncated", ~F.min("__fits").over(Window.partitionBy())).where("__fits").drop("__fits")


def list_files(files: DataFrame, pattern: str, extensions: list[str], ignore_dirs: list[str], most: int = GLOB_FILES) -> DataFrame:
    """``path``: indexable files that match a glob, the first ones by name."""
    return _listed(files, pattern, extensions, ignore_dirs).orderBy("path").limit(most)


def _listed(files: DataFrame, pattern: str, extensions: list[str], ignore_dirs: list[str]) -> DataFrame:
    return files.where(F.col("path").rlike(glob_regex(pattern)) & include_file("path", "size_kb", extensions, ignore_dirs)).select("path")


def list_files_marked(files: DataFrame, pattern: str, extensions: list[str], ignore_dirs: list[str], most: int = GLOB_FILES) -> DataFrame:
    """``path, truncated``: as ``list_files``, and whether there were more."""
    some = _listed(files, pattern, extensions, ignore_dirs).orderBy("path").limit(most + 1)
    place = some.withColumn("__n", F.row_number().over(Window.orderBy("path"))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return place.where(F.col("__n") <= most).drop("__n")


def window(text: Column | str, start: int, end: int, max_chars: int = READ_CHARS) -> Column:
    """``struct<content, start_line, end_line, total_lines, truncated>`` of a range of lines, cut after the last that fits."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n")
    total = F.size(lines)
    first = F.least(F.greatest(F.lit(1), F.lit(start)), total)
    last = F.least(F.greatest(first, F.lit(end)), total)
    chosen = F.array_join(F.slice(lines, first, last - first + 1), "\n")
    fits = F.length(chosen) <= max_chars
    prefix = F.left(chosen, F.lit(max(0, max_chars - 1)))
    whole = F.regexp_extract(prefix, r"^([\s\S]*)\n[^\n]*$", 1)
    broken = F.contains(prefix, F.lit("\n"))
    cut = F.lit("…"[: max(0, max_chars)]) if max_chars <= 1 else F.concat(F.when(broken, whole).otherwise(prefix), F.lit("…"))
    shown = F.when(broken, F.size(F.split(whole, "\n"))).otherwise(1) if max_chars > 1 else F.lit(1)
    return F.struct(
        F.when(fits, chosen).otherwise(cut).alias("content"),
        first.alias("start_line"),
        F.when(fits, last).otherwise(first + shown - 1).alias("end_line"),
        total.alias("total_lines"),
        (~fits).alias("truncated"),
    )


def gitignored(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """``path, ignored`` by the last matching line of ``line_no, pattern``.

    ``*`` and ``?`` cross folders; a line with a slash inside, or anchored, is matched against the whole
    path, others against every part; a folder line never matches a path of one part.
    """
    raw = F.trim("pattern")
    lines = patterns.select("line_no", raw.alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    lines = lines.select("line_no", F.col("p").startswith("!").alias("negate"), F.regexp_replace("p", "^!", "").alias("p"))
    lines = lines.select("line_no", "negate", F.col("p").endswith("/").alias("dir_only"), F.regexp_replace("p", "/$", "").alias("p"))
    lines = lines.select("line_no", "negate", "dir_only", F.col("p").startswith("/").alias("anchored"), F.regexp_replace("p", "^/", "").alias("core")).where("core <> ''")
    rx = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("core", r"([.+^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    rules = F.array_sort(F.collect_list(F.struct("line_no", "negate", "dir_only", (F.col("anchored") | F.contains("core", F.lit("/"))).alias("whole"), rx.alias("rx"))))
    rule_list = lines.agg(rules.alias("rules"))  # one row: the lines of an ignore file
    normal = paths.select("path", F.regexp_replace("path", r"^\./", "").alias("n")).withColumn("one", F.lit(1))
    both = normal.join(F.broadcast(rule_list.withColumn("one", F.lit(1))), "one")
    parts = F.split("n", "/")
    hit = lambda r: F.when(r["dir_only"] & (F.size(parts) == 1), False).when(r["whole"], F.regexp_like("n", r["rx"])).otherwise(F.exists(parts, lambda s: F.regexp_like(s, r["rx"])))
    verdict = F.aggregate("rules", F.lit(False), lambda a, r: F.when(hit(r), ~r["negate"]).otherwise(a))
    return both.select("path", verdict.alias("ignored"))


def grounded(texts: DataFrame, known: DataFrame, id: str = "id") -> DataFrame:
    """``id, text, changed, dropped``: lines that name an unknown file in back ticks are dropped.

    A name is a file if it has two parts or more; ``path/to/`` before it is taken off.
    """
    lines = texts.select(id, F.posexplode(F.split("text", "\n")).alias("no", "line"))
    raw = F.regexp_extract_all("line", F.lit(r"`([^`\n]+)`"), F.lit(1))
    names = lines.select(id, "no", F.explode(F.filter(raw, lambda x: x.rlike(r"^[\w.-]+(/[\w.-]+)+$"))).alias("raw")).withColumn("path", F.regexp_replace("raw", "^path/to/", ""))
    seen = names.join(known.select("path").distinct().withColumn("known", F.lit(True)), "path", "left")
    bad = seen.groupBy(id, "no").agg(F.max(F.col("known").isNull()).alias("bad"), F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("raw")))).alias("lost"))
    joined = lines.join(bad, [id, "no"], "left")
    clean = F.regexp_replace("line", r"`path/to/([\w.-]+(?:/[\w.-]+)+)`", "`$1`")
    keep = ~F.coalesce("bad", F.lit(False))
    # a text with a name that is no file below path/to stays as it is: the pattern needs two parts
    done = joined.groupBy(id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("no", clean.alias("t"))))), lambda x: x["t"]), "\n").alias("text"),
        F.max(F.coalesce("bad", F.lit(False)) | (clean != F.col("line"))).alias("changed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(~keep, F.struct("no", "lost")))), lambda x: x["lost"])).alias("dropped"),
    )
    return done

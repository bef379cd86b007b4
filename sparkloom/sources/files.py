"""Reading repositories and writing results: file scans, submodules, aliases, memory blocks, exports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import MAX_FILE_KB, include_file


def scan_files(spark: SparkSession, root: str, extensions: list[str], ignore_dirs: list[str], max_kb: float = MAX_FILE_KB) -> tuple[DataFrame, DataFrame]:
    """Files of a folder: ``path, content, size_kb`` of those to index, and ``path, size_kb`` of the too large ones.

    Contents are read as UTF-8; hidden files and folders are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:(//[^/]*)?", ""), "^/*" + re.escape(base.lstrip("/")) + "/", "")
    files = found.select(path.alias("path"), (F.col("length") / 1024).alias("size_kb"), "content").where(~F.col("path").rlike(r"(^|/)\."))
    listed = files.where(include_file("path", F.lit(0.0), extensions, ignore_dirs))
    small = listed.where(F.col("size_kb") <= max_kb).select("path", F.decode("content", "UTF-8").alias("content"), "size_kb")
    return small, listed.where(F.col("size_kb") > max_kb).select("path", "size_kb")


def submodules(status: DataFrame) -> DataFrame:
    """``path, commit, initialised`` of the lines of a submodule status; malformed lines go."""
    line = r"^([ +\-U]?)([0-9a-f]{7,64}) (\S.*?)(?: \([^)]*\))?$"
    rows = status.select(F.explode(F.split("output", "\n")).alias("line")).where(F.col("line").rlike(line))
    return rows.select(F.regexp_extract("line", line, 3).alias("path"), F.regexp_extract("line", line, 2).alias("commit"), (F.regexp_extract("line", line, 1) != "-").alias("initialised"))


def expanded_submodules(subs: DataFrame, files: DataFrame) -> DataFrame:
    """Files of initialised submodules under their folder: ``files`` has ``submodule, path, content, size_kb``."""
    ready = subs.where("initialised").select(F.col("path").alias("submodule"))
    return files.join(ready, "submodule").select(F.concat_ws("/", "submodule", "path").alias("path"), "content", "size_kb")


def plain_json(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings stay."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = token.sub(lambda m: m.group() if m.group().startswith('"') else " ", text)
    comma = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)
    return comma.sub(lambda m: m.group() if m.group().startswith('"') else "", bare)


def path_aliases(spark: SparkSession, config: str, base: str = "") -> DataFrame:
    """``ord, pattern, target`` of a compiler configuration's path aliases, targets put under its base."""
    options = json.loads(plain_json(config)).get("compilerOptions") or {}
    root, rows = str(options.get("baseUrl", ".")), []
    for pattern, targets in (options.get("paths") or {}).items():
        for target in targets if isinstance(targets, list) else []:
            if isinstance(target, str) and target:
                parts = [p for p in (base, "" if target.startswith(("./", "../", "/")) else root, target) if p not in ("", ".")]
                rows.append((len(rows), pattern, "/".join(parts)))
    return spark.createDataFrame(rows, "ord int, pattern string, target string")


def repository_aliases(files: DataFrame, folder: str = "") -> DataFrame:
    """Path aliases of a folder's compiler configuration among ``path, content``: tsconfig.json, or else jsconfig.json; none without either."""
    names = [f"{folder}/{n}".lstrip("/") for n in ("tsconfig.json", "jsconfig.json")]
    found = {r.path: r.content for r in files.where(F.col("path").isin(names)).select("path", "content").collect()}  # two at most
    text = next((found[n] for n in names if n in found), "{}")
    return path_aliases(files.sparkSession, text, folder)


def configured_aliases(configs: DataFrame) -> DataFrame:
    """``repo, ord, pattern, target`` of many compiler configurations at once: ``repo, content`` and, where given, ``folder``.

    As ``path_aliases``, in one job: comments and trailing commas go, patterns keep their order, targets that are no strings and values that are no lists are left out, and
    so are texts that are no JSON.
    """
    string = r'("(?:[^"\\]++|\\.)*+")'
    bare = F.regexp_replace("content", string + r"|//[^\n]*+|/\*[\s\S]*?\*/", "$1")
    plain = F.regexp_replace(bare, string + r"|,(?=\s*[}\]])", "$1")
    options = F.from_json(plain, "compilerOptions struct<baseUrl: string, paths: map<string, string>>").getField("compilerOptions")
    folder = F.coalesce(F.col("folder"), F.lit("")) if "folder" in configs.columns else F.lit("")
    rows = configs.select("repo", folder.alias("folder"), options.alias("o")).select("repo", "folder", F.coalesce("o.baseUrl", F.lit(".")).alias("root"), F.posexplode(F.map_entries("o.paths")).alias("pos", "e"))
    rows = rows.where(F.col("e.value").startswith("[")).select("repo", "folder", "root", "pos", F.col("e.key").alias("pattern"), F.try_parse_json("e.value").alias("list"))
    each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("list").outer()).toDF("at", "key", "item")).where("schema_of_variant(item) = 'STRING'")
    each = each.withColumn("to", F.variant_get("item", "$", "string")).where("to <> ''")
    root = F.when(F.col("to").rlike(r"^(\./|\.\./|/)"), "").otherwise(F.col("root"))
    target = F.array_join(F.filter(F.array("folder", root, "to"), lambda p: ~p.isin("", ".")), "/")
    number = F.row_number().over(Window.partitionBy("repo").orderBy("pos", "at")) - 1  # within one configuration
    return each.select("repo", number.alias("ord"), "pattern", target.alias("target"))


def save_blocks(blocks: DataFrame, folder: str) -> None:
    """Write ``label, updated_at, source_commit, value`` as one text file with a front matter for each label."""
    format_block(blocks).repartition("label").write.mode("overwrite").partitionBy("label").text(folder)


def load_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``label, updated_at, source_commit, value`` of a folder that ``save_blocks`` wrote."""
    files = spark.read.option("basePath", folder).text(f"{folder}/label=*", wholetext=True)
    text = F.regexp_replace("value", r"\n$", "")  # the line end of a text file
    return parse_block(files.select(F.col("label").alias("path"), text.alias("content"))).select(F.coalesce("label", "path").alias("label"), "updated_at", "source_commit", "value")


def parse_block(files: DataFrame) -> DataFrame:
    """``path, label, updated_at, source_commit, value`` of memory files with a front matter; without one all is value."""
    rx = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?([\s\S]*)$"
    has = F.col("content").rlike(rx)
    head = F.when(has, F.regexp_extract("content", rx, 1))
    field = lambda k: F.when(head.rlike(rf"(?m)^{k}:"), F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*([^\r\n]*)", 1)))
    value = F.when(has, F.regexp_replace(F.regexp_extract("content", rx, 2), r"^\r?\n", "")).otherwise(F.col("content"))
    return files.select("path", field("label").alias("label"), field("updated_at").alias("updated_at"), field("source_commit").alias("source_commit"), value.alias("value"))


def format_block(blocks: DataFrame) -> DataFrame:
    """``label, content`` of ``label, updated_at, source_commit, value``."""
    commit = F.when(F.col("source_commit").isNotNull(), F.concat(F.lit("\nsource_commit: "), "source_commit")).otherwise("")
    return blocks.select("label", F.concat(F.lit("---\nlabel: "), "label", F.lit("\nupdated_at: "), F.col("updated_at").cast("string"), commit, F.lit("\n---\n\n"), "value").alias("content"))


def config_issues(repos: DataFrame) -> DataFrame:
    """``repo, issue`` of ``repo, extensions, ignore_dirs``."""
    ext = repos.select("repo", F.explode("extensions").alias("x")).where("not startswith(x, '.')").select("repo", F.concat(F.lit("extension without a dot: "), "x").alias("issue"))
    dirs = repos.select("repo", F.explode("ignore_dirs").alias("x")).where(F.col("x").rlike(r"[/\\]")).select("repo", F.concat(F.lit("ignored folder with a separator: "), "x").alias("issue"))
    return ext.unionByName(dirs)


def export_text(blocks: DataFrame, passages: DataFrame) -> DataFrame:
    """``agent_id, markdown``: an agent's memory blocks and indexed files as one document."""
    part = F.concat(F.lit("## "), "label", F.lit("\n\n"), "value")
    memory = blocks.groupBy("agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("m"))
    files = passages.where("file_path is not null").select("agent_id", "file_path").distinct().groupBy("agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("file_path")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("f"))
    return memory.join(files, "agent_id", "left").select("agent_id", F.concat_ws("\n\n", "m", F.concat(F.lit("## Files\n\n"), "f")).alias("markdown"))

"""Incremental synchronisation by content hash, reconciliation, and the passage store's upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..storage import kept

FULL_REINDEX_FILES, CONSOLIDATE_FILES, MAX_FILE_KB = 500, 5, 1024


def content_hashes(files: DataFrame) -> DataFrame:
    """``path, sha256`` of ``path, content``."""
    return files.select("path", content_hash("content").alias("sha256"))


def hash_diff(changed: DataFrame, files: DataFrame, stored: DataFrame, max_kb: float = MAX_FILE_KB) -> DataFrame:
    """``path, action, sha256`` of every changed path: removed, reindexed or unchanged.

    A path without a file, or with one that is too large, is removed, whether it was known or not.
    """
    now = files.select("path", "size_kb", content_hash("content").alias("sha256"))
    both = changed.select("path").distinct().join(now, "path", "left").join(stored.select("path", F.col("sha256").alias("old")), "path", "left")
    gone = F.col("sha256").isNull() | (F.col("size_kb") > max_kb)
    action = F.when(gone, "removed").when(F.col("old").eqNullSafe(F.col("sha256")), "unchanged").otherwise("reindexed")
    return both.select("path", action.alias("action"), F.when(~gone, F.col("sha256")).alias("sha256"))


def sync_plan(changed: DataFrame, passage_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages to delete (``path, passage_id``) and one row ``n_files, is_full`` of a change of these paths."""
    paths = changed.select("path").distinct()
    old = passage_map.join(paths, "path", "left_semi").select("path", "passage_id")
    return old, paths.agg(F.count("*").alias("n_files"), (F.count("*") > FULL_REINDEX_FILES).alias("is_full"))


def orphans(store: DataFrame, local: DataFrame, id: str = "id") -> DataFrame:
    """Ids in the store that the local map does not know."""
    return store.select(id).distinct().join(local.select(id).distinct(), id, "left_anti")


def missing(store: DataFrame, local: DataFrame, id: str = "id") -> DataFrame:
    """Ids in the local map that the store does not hold."""
    return orphans(local, store, id)


def cleaned_map(passage_map: DataFrame, lost: DataFrame, id: str = "passage_id") -> DataFrame:
    """``path, ids`` (in order) of a map ``path, pos, id`` without lost ids; paths left empty go."""
    kept = passage_map.join(lost.select(F.col(lost.columns[0]).alias(id)), id, "left_anti")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", id))), lambda x: x[id])
    return kept.groupBy("path").agg(lists.alias("ids"))


def drift(store: DataFrame, local: DataFrame, id: str = "id") -> DataFrame:
    """One row ``orphans, missing, in_sync``."""
    o, m = orphans(store, local, id).agg(F.count("*").alias("orphans")), missing(store, local, id).agg(F.count("*").alias("missing"))
    both = o.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("in_sync", (F.col("orphans") == 0) & (F.col("missing") == 0))


def consistency(config: DataFrame, state: DataFrame, store: DataFrame, key: str = "repo") -> DataFrame:
    """``repo, issue``: repositories that only some of configuration, state and store know."""
    parts = [(state, config, "state without configuration"), (config, state, "configuration without state"), (state, store, "state without store")]
    out = [a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("issue", F.lit(i)) for a, b, i in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n")


def upsert(store: DataFrame, batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The store after a batch: of a key's rows in store and batch, the last of the batch stays, with a new number.

    ``batch`` has the store's columns; its ``seq`` orders it. New numbers follow the store's highest.
    """
    top = store.agg(F.coalesce(F.max(seq), F.lit(0)).alias("t")).first().t
    fresh = latest(batch, keys, seq)
    # batch numbers only order it: the step of the partition keeps them ordered without sorting all in one task
    fresh = fresh.withColumn(seq, (F.lit(top) + F.col(seq)).cast(store.schema[seq].dataType))
    kept = store.join(batch.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh.select(*store.columns))


def numbered(rows: DataFrame, column: str = "seq") -> DataFrame:
    """Rows with numbers from 1 without gaps, in their order; no task numbers all."""
    parts = kept(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    return parts.withColumn("__n", number).join(F.broadcast(base), "__part").withColumn(column, F.col("__base") + F.col("__n")).drop("__part", "__at", "__base", "__n")


def checked_dimension(vectors: DataFrame, dimension: int | None, column: str = "embedding") -> tuple[DataFrame, int | None]:
    """Vectors whose dimension is the store's, or, for an empty store, that of the first; others raise."""
    if dimension is None:
        first = vectors.select(F.size(column).alias("n")).limit(1).collect()
        dimension = first[0].n if first else None
    if dimension is None:
        return vectors, None
    text = F.concat(F.lit(f"the store's dimension is {dimension}, not "), F.size(column).cast("string"))
    return vectors.where(F.when(F.size(column) == dimension, True).otherwise(F.raise_error(text).cast("boolean"))), dimension


def delete(store: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The store without some keys; unknown keys do nothing."""
    return store.join(ids.select(*keys).distinct(), keys, "left_anti")


def should_sync(last: Column, head: Column) -> Column:
    return ~last.eqNullSafe(head)


def consolidates(n_files: Column, enabled: Column, head: Column, last_sync: Column, last_consolidated: Column) -> Column:
    """Whether a sync is followed by a consolidation of the memory blocks."""
    done = head.eqNullSafe(last_sync) & head.eqNullSafe(last_consolidated)
    return enabled & (n_files >= CONSOLIDATE_FILES) & ~done


def setup_mode(known: Column, has_passages: Column, bootstrapped: Column, in_store: Column, reindex: Column) -> Column:
    """What a setup does: create, resume_full, resume_bootstrap, reindex_full or skip."""
    return (
        F.when(~F.coalesce(known, F.lit(False)) | ~F.coalesce(in_store, F.lit(True)), "create")
        .when(F.coalesce(reindex, F.lit(False)), "reindex_full")
        .when(~F.coalesce(has_passages, F.lit(False)), "resume_full")
        .when(~F.coalesce(bootstrapped, F.lit(False)), "resume_bootstrap")
        .otherwise("skip")
    )


def evidence_source(checkpoint: Column, exists: Column, since: Column) -> Column:
    """Which commits to read: the range from a checkpoint, those since a time, or the last ones; a lost checkpoint raises."""
    lost = F.raise_error(F.concat(F.lit("checkpoint commit not found: "), checkpoint)).cast("string")
    return F.when(checkpoint.isNotNull(), F.when(exists, F.concat(F.lit("range:"), checkpoint)).otherwise(lost)).when(since.isNotNull(), F.concat(F.lit("since:"), since)).otherwise("recent:20")


def changed_files(paths: DataFrame, submodules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed paths parted into submodules (``path`` of a submodule itself) and regular files."""
    subs = submodules.select("path").distinct()
    distinct = paths.select("path").distinct()
    return distinct.join(subs, "path", "left_semi"), distinct.join(subs, "path", "left_anti")


def fingerprint(blocks: DataFrame, by: list[str]) -> DataFrame:
    """A digest of each group's blocks ``label, value``, in the order of labels."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda b: F.concat(b["label"], F.lit("\0"), b["value"], F.lit("\0")))
    return blocks.groupBy(*by).agg(F.sha2(F.array_join(parts, ""), 256).alias("fingerprint"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``label, changed`` of two versions of memory blocks."""
    both = before.select("label", F.col("value").alias("a")).join(after.select("label", F.col("value").alias("b")), "label", "full_outer")
    return both.select("label", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def extension_histogram(files: DataFrame, top: int = 10) -> DataFrame:
    """``ext, n``: the most common extensions but those of assets; ties by first appearance (``pos``)."""
    from ..functions.paths import ASSET_EXTENSIONS

    ext = F.regexp_extract(F.substring_index("path", "/", -1), r"[^.](\.[^.]*)$", 1)
    named = files.select("pos", ext.alias("ext")).where((F.col("ext") != "") & (F.col("ext") != ".") & ~F.lower("ext").isin(*ASSET_EXTENSIONS))
    counts = named.groupBy("ext").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(top).select("ext", "n")


def suggested_ignores(files: DataFrame) -> DataFrame:
    """``dir``: the usually ignored folders that occur."""
    from ..functions.paths import IGNORE_DIRS

    return files.select(F.explode(F.split("path", "/")).alias("dir")).where(F.col("dir").isin(*IGNORE_DIRS)).distinct()


def agent_stats(passage_map: DataFrame, store: DataFrame) -> DataFrame:
    """``repo, files, passages, stored, drift`` of each repository."""
    local = passage_map.groupBy("repo").agg(F.countDistinct("path").alias("files"), F.count("passage_id").alias("passages"))
    kept = store.groupBy("repo").agg(F.count("*").alias("stored"))
    return local.join(kept, "repo", "left").withColumn("stored", F.coalesce("stored", F.lit(0))).withColumn("drift", F.col("stored") - F.col("passages"))


def commit_prefix(commits: DataFrame, max_chars: int, by: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """The newest commits whose texts, one character between them, fit; ``omitted`` counts the others of the group."""
    order = Window.partitionBy(*by).orderBy(pos)
    used = F.sum(F.length(text) + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = commits.withColumn("__fits", used <= max_chars + 1)
    omitted = F.sum((~F.col("__fits")).cast("int")).over(Window.partitionBy(*by))
    return marked.withColumn("omitted", omitted).where("__fits").drop("__fits")


def capped_paths(paths: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """The first paths of each group as lines, and how many more there are."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy("path"))
    total = F.count("*").over(Window.partitionBy(*by))
    top = paths.withColumn("n", number).withColumn("total", total).where(F.col("n") <= most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: F.concat(F.lit("- "), x["path"])), "\n")
    more = F.max("total") - most
    return top.groupBy(*by).agg(F.concat(lines, F.when(more > 0, F.concat(F.lit("\n…and "), more.cast("string"), F.lit(" more"))).otherwise("")).alias("lines"))


def status(agents: DataFrame, passages: DataFrame, blocks: DataFrame, state: DataFrame) -> DataFrame:
    """``agent_id, name, passages, blocks, last_bootstrap, last_sync_commit, last_sync_at, last_consolidated_at, report`` of each agent.

    ``blocks`` maps labels to their characters; what never happened is null, and "never" in the report.
    """
    counts = passages.groupBy("agent_id").agg(F.count("*").alias("passages"))
    sizes = blocks.groupBy("agent_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.length("value").alias("chars"))))).alias("blocks"))
    times = ["last_bootstrap", "last_sync_commit", "last_sync_at", "last_consolidated_at"]
    out = agents.select("agent_id", "name").join(counts, "agent_id", "left").join(sizes, "agent_id", "left").join(state.select("agent_id", *times), "agent_id", "left").withColumn("passages", F.coalesce("passages", F.lit(0)))
    memory = F.transform(F.map_entries("blocks"), lambda e: F.concat(F.lit("    "), e["key"], F.lit(": "), e["value"].cast("string"), F.lit(" chars")))
    never = [F.concat(F.lit("  " + t.replace("_", " ").replace(" commit", "") + ": "), F.coalesce(F.col(t), F.lit("never"))) for t in times]
    head = [F.concat("name", F.lit(":")), F.concat(F.lit("  agent: "), "agent_id"), F.concat(F.lit("  passages: "), F.col("passages").cast("string"))]
    return out.withColumn("report", F.concat_ws("\n", *head, F.when(F.size("blocks") > 0, F.concat_ws("\n", F.lit("  memory blocks:"), F.array_join(memory, "\n"))), *never))


def sync_line(repo: Column, before: Column, now: Column, files: Column, ms: Column) -> Column:
    """The log line of a sync."""
    start = F.coalesce(F.left(before, F.lit(7)), F.lit("initial"))
    return F.concat(F.lit("["), repo, F.lit("] synced "), start, F.lit(".."), F.left(now, F.lit(7)), F.lit(" ("), files.cast("string"), F.lit(" files, "), F.format_string("%.1f", ms / 1000), F.lit("s)"))


def doctor(checks: DataFrame, strict: bool = False) -> DataFrame:
    """``issues, exit_code`` of ``status`` (pass, warn, fail): 1 with a failure, or, if strict, a warning."""
    bad = F.col("status").isin("fail", "warn") if strict else F.col("status") == "fail"
    return checks.agg(F.count_if(F.col("status") != "pass").alias("issues"), F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("exit_code"))

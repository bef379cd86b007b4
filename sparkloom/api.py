"""The engine: passages, memory blocks and sync state of agents as tables in a folder, with search over them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import IGNORE_DIRS, like_prefix
from .functions.text import index_terms, normalised, source_path, stub_embedding, task_prefix
from .operators import graph, inverted, lines, load, search, symbols, sync
from .sources import changes, git
from .sources import files as sources
from .sources.store import Table
from .storage import kept
from .streaming import live, watch

PASSAGES = "agent_id string, id string, file_path string, text string, terms array<string>, dl int, embedding array<float>, seq long, created_at timestamp"
BLOCKS = "agent_id string, label string, value string"
AGENTS = "agent_id string, name string, model string, tags array<string>, created_at timestamp"
HASHES = "agent_id string, path string, sha256 string"
DEF = "path: string, kind: string, name: string, owner: string, qualified: string, line: int, end_line: int, pos: int"
REF = "path: string, kind: string, module: string, names: array<struct<local: string, name: string>>, callee: string, object: string"
SYMBOLS = f"agent_id string, path string, defs array<struct<{DEF}>>, refs array<struct<{REF}>>"
RANKS = "agent_id string, id string, rank double"
INDEXES = "name string, version long, path string"
STATE = "agent_id string, last_bootstrap string, last_sync_commit string, last_sync_at string, last_consolidated_at string"
EDITABLE_BLOCKS = ("architecture", "conventions")


class Engine:
    """Agents, passages and blocks under a root folder that Spark can read and write.

    Tables are laid out by agent and only ever added to (``sources.store``), so a search of one agent reads that agent's
    rows, a write adds its own rows, and readers never see half of a write. ``compact`` rewrites what was replaced,
    ``build_index`` inverts the passages for word search. ``embed``
    maps a text column to an embedding column (the default is a deterministic stub), and ``chunk`` maps
    ``path, content`` to ``source_path, chunk_no, text`` (the default cuts by symbols).
    """

    def __init__(self, spark: SparkSession, root: str, embed=stub_embedding, model: str = "stub", chunk: Callable[[DataFrame], DataFrame] = symbols.symbol_chunks):
        self.spark, self.root, self.embed, self.model, self.chunk = spark, root.rstrip("/"), embed, model, chunk
        keys = {"passages": (PASSAGES, ["agent_id", "id"]), "blocks": (BLOCKS, ["agent_id", "label"]), "agents": (AGENTS, ["agent_id"]), "state": (STATE, ["agent_id"]), "hashes": (HASHES, ["agent_id", "path"]), "indexes": (INDEXES, ["name"]), "symbols": (SYMBOLS, ["agent_id", "path"]), "ranks": (RANKS, ["agent_id", "id"])}
        self.tables = {name: Table(spark, f"{self.root}/{name}", schema, key) for name, (schema, key) in keys.items()}

    @property
    def passages(self) -> DataFrame:
        return self.tables["passages"].read()

    @property
    def blocks(self) -> DataFrame:
        return self.tables["blocks"].read()

    @property
    def agents(self) -> DataFrame:
        return self.tables["agents"].read()

    @property
    def state(self) -> DataFrame:
        """When and at which commit each agent was synchronised; agents without an entry have none."""
        return self.tables["state"].read()

    def load(self, agent_id: str, files: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = load.BATCH) -> load.Loaded:
        """Chunk files and write what a service embeds, ``batch`` texts a call; calls that fail are counted, and their chunks returned with their errors."""
        chunks = self.chunk(files).select(F.lit(agent_id).alias("agent_id"), F.concat_ws("#", "source_path", F.col("chunk_no").cast("string")).alias("id"), "source_path", "text")
        prefix = task_prefix(self.model, "document")
        done = load.load(chunks, (lambda texts: embed([prefix + t for t in texts])) if prefix else embed, batch)
        if done.loaded:
            self.write_passages(done.rows.select("agent_id", "id", "text", "embedding"))
        return done

    def hashes(self, agent_id: str) -> DataFrame:
        """``path, sha256`` of the files that an agent's passages were made of."""
        return self.tables["hashes"].read(F.col("agent_id") == agent_id).select("path", "sha256")

    def passage_map(self, agent_id: str) -> DataFrame:
        """``path, pos, passage_id`` of an agent's indexed files."""
        path, number = F.regexp_extract("id", "^(.*)#([0-9]+)$", 1), F.regexp_extract("id", "^(.*)#([0-9]+)$", 2)
        rows = self.tables["passages"].read(F.col("agent_id") == agent_id)
        return rows.where(F.col("id").rlike("#[0-9]+$")).select(path.alias("path"), number.cast("int").alias("pos"), F.col("id").alias("passage_id"))

    def compact(self) -> None:
        """Rewrite every table without what was replaced."""
        for table in self.tables.values():
            table.compact()

    def create_agent(self, agent_id: str, name: str, tags: list[str] | None = None) -> None:
        row = self.spark.createDataFrame([(agent_id, name, self.model, tags or [])], "agent_id string, name string, model string, tags array<string>")
        self.tables["agents"].put(row.withColumn("created_at", F.current_timestamp()))

    def has_agent(self, agent_id: str) -> bool:
        return bool(self.agents.where(F.col("agent_id") == agent_id).limit(1).count())

    def delete_agent(self, agent_id: str) -> None:
        for table in self.tables.values():
            if table.keys[0] == "agent_id":
                table.remove(table.read(F.col("agent_id") == agent_id))

    def purge(self, agent_id: str) -> None:
        self.tables["passages"].remove(self.passages.where(F.col("agent_id") == agent_id))

    def save_state(self, agent_id: str, **fields: str) -> None:
        """Set some of ``last_bootstrap, last_sync_commit, last_sync_at, last_consolidated_at``; the others stay."""
        names = self.tables["state"].schema.names[1:]
        if unknown := set(fields) - set(names):
            raise ValueError(f"no such state: {', '.join(sorted(unknown))}")
        old = self.state.where(F.col("agent_id") == agent_id).head(1)
        new = {**(old[0].asDict() if old else {}), **fields}
        self.tables["state"].put(self.spark.createDataFrame([(agent_id, *[new.get(n) for n in names])], STATE))

    def write_passages(self, batch: DataFrame) -> None:
        """Upsert ``agent_id, id, text`` (of equal keys the row with the greatest ``seq``, or else the last row, stays), and ``embedding`` where given."""
        store = self.tables["passages"]
        rows = batch if "seq" in batch.columns else sync.numbered(batch)
        rows = sync.latest(rows, ["agent_id", "id"], "seq")
        given = F.col("embedding") if "embedding" in rows.columns else self.embed(F.concat(F.lit(task_prefix(self.model, "document")), F.col("text")))
        vector = normalised(given).cast("array<float>")
        notes = store.info()
        top, known = notes.get("seq", 0), notes.get("dimension")
        rows = rows.select("agent_id", "id", source_path("text").alias("file_path"), "text", index_terms("text").alias("terms"), vector.alias("embedding"), (F.col("seq") + top).cast("long").alias("seq"), F.current_timestamp().alias("created_at"))
        rows, _ = sync.checked_dimension(rows.withColumn("dl", F.size("terms")), known)
        # the next write begins where this one ends, and reads no passages for it
        store.put(rows, lambda part: {k: v for k, v in part.agg(F.max("seq").alias("seq"), F.max(F.size("embedding")).alias("dimension")).first().asDict().items() if v is not None})

    def delete_passages(self, ids: DataFrame) -> None:
        self.tables["passages"].remove(ids)

    def read_passage(self, agent_id: str, id: str) -> str:
        found = self.passages.where((F.col("agent_id") == agent_id) & (F.col("id") == id)).select("text").head(1)
        if not found:
            raise KeyError(f"no passage {id} of agent {agent_id}")
        return found[0].text

    def list_passages(self, agent_id: str) -> DataFrame:
        return self.passages.where(F.col("agent_id") == agent_id).orderBy("seq")

    def set_block(self, agent_id: str, label: str, value: str) -> None:
        self.tables["blocks"].put(self.spark.createDataFrame([(agent_id, label, value)], BLOCKS))

    def memory_replace(self, agent_id: str, label: str, value: str) -> None:
        """The assistant's way to set a block: only some labels."""
        if label not in EDITABLE_BLOCKS:
            raise ValueError(f"{label} is none of {', '.join(EDITABLE_BLOCKS)}")
        self.set_block(agent_id, label, value)

    def block(self, agent_id: str, label: str) -> str:
        found = self.blocks.where((F.col("agent_id") == agent_id) & (F.col("label") == label)).head(1)
        return found[0].value if found else ""

    def core_memory(self, agent_id: str) -> DataFrame:
        """``label, value`` of an agent's blocks."""
        return self.blocks.where(F.col("agent_id") == agent_id).select("label", "value").orderBy("label")

    def search(self, agent_id: str, queries: DataFrame, limit: int = 10, path_prefix: str | None = None) -> DataFrame:
        """``query_id, id, text, score, rank`` of ``query_id, query``; word statistics cover all agents."""
        vector, lexical, scope = self._legs(agent_id, queries, limit, path_prefix)
        return search.hybrid(vector, lexical, limit).join(scope.select("id", "text"), "id")

    def search_legs(self, agent_id: str, queries: DataFrame, limit: int = 10) -> DataFrame:
        vector, lexical, _ = self._legs(agent_id, queries, limit, None)
        return search.legs(vector, lexical, limit)

    def search_tool(self, agent_id: str, query: str, top: int = 5, path_prefix: str | None = None) -> str:
        """The assistant's search: a JSON list of results."""
        queries = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        vector, lexical, scope = self._legs(agent_id, queries, min(20, 2 * min(10, max(1, top))), path_prefix)
        found = search.tool_search(vector, lexical, scope, top).orderBy("position").select("id", "file_path", "text", "score", "truncated")
        return json.dumps([r.asDict() for r in found.collect()], ensure_ascii=False)  # ten at most

    def _legs(self, agent_id: str, queries: DataFrame, limit: int, path_prefix: str | None):
        every = self.passages
        inside = F.col("agent_id") == agent_id
        if path_prefix:
            inside = inside & like_prefix("file_path", path_prefix)
        k = search.candidates(limit) if limit > 0 else 0
        asked = queries.select("query_id", normalised(self.embed(F.concat(F.lit(task_prefix(self.model, "query")), F.col("query")))).cast("array<float>").alias("vector"))
        scope = every.where(inside)
        vector = kept(search.vector_top_k(scope, asked, k), "vector-leg")
        index = self._index()
        lexical = search.bm25(every, queries, k, scope=inside) if index is None else index.bm25(queries, k, group=agent_id, scope=scope if path_prefix else None)
        return vector, kept(lexical, "lexical-leg"), scope

    def build_index(self) -> None:
        """Invert all passages as they are now; searches use it until passages change, and scan their terms from then on."""
        version = (self.tables["passages"].pointer() or {"version": 0})["version"]
        path = f"{self.root}/inverted/{version}-{uuid.uuid4().hex}"
        inverted.InvertedIndex.write(self.passages.select("agent_id", "id", "terms"), path, group="agent_id")
        self.tables["indexes"].put(self.spark.createDataFrame([("passages", version, path)], INDEXES))

    def _index(self) -> inverted.InvertedIndex | None:
        """The index of the passages' last version, if there is one."""
        now = self.tables["passages"].pointer()
        row = self.tables["indexes"].read(F.col("name") == "passages").head(1) if now else []
        return inverted.InvertedIndex(self.spark, row[0].path) if row and row[0].version == now["version"] else None

    def index(self, agent_id: str, files: DataFrame) -> None:
        """Chunk ``path, content`` and write the chunks and the files' hashes; a chunk's id is its path and number."""
        made = self.chunk(files)
        self.write_passages(made.select(F.lit(agent_id).alias("agent_id"), F.concat_ws("#", "source_path", F.col("chunk_no").cast("string")).alias("id"), "text"))
        self.tables["hashes"].put(sync.content_hashes(files).dropDuplicates(["path"]).select(F.lit(agent_id).alias("agent_id"), "path", "sha256"))

    def sync(self, agent_id: str, changed: DataFrame, files: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
        """Apply changed paths: new chunks are written before old ones go, and hashes last, so that what fails is done again; gives ``path, action, sha256``.

        ``hashes`` (``path, sha256`` of what is indexed) are by default those that earlier runs kept.
        """
        plan = kept(sync.hash_diff(changed, files, self.hashes(agent_id) if hashes is None else hashes), "sync-plan")
        again = files.join(plan.where("action = 'reindexed'"), "path", "left_semi")
        before = self.passages.where(F.col("agent_id") == agent_id)
        made = self.chunk(again).select(F.lit(agent_id).alias("agent_id"), F.concat_ws("#", "source_path", F.col("chunk_no").cast("string")).alias("id"), "text")
        path = F.regexp_replace("id", "#[0-9]+$", "")
        stale = before.withColumn("path", path).join(plan.where("action <> 'unchanged'"), "path", "left_semi").select("agent_id", "id").join(made.select("id"), "id", "left_anti")
        if again.limit(1).count():
            self.write_passages(made)
        stale = kept(stale.select("agent_id", "id"), "stale")
        if stale.limit(1).count():
            self.delete_passages(stale)
        own = plan.select(F.lit(agent_id).alias("agent_id"), "path", "sha256", "action")
        if own.where("action = 'reindexed'").limit(1).count():
            self.tables["hashes"].put(own.where("action = 'reindexed'").drop("action"))
        removed = own.where("action = 'removed'")
        if removed.limit(1).count():
            self.tables["hashes"].remove(removed)
        if self.tables["symbols"].read(F.col("agent_id") == agent_id).limit(1).count():  # who keeps symbols keeps them in step
            if again.limit(1).count():
                self.index_symbols(agent_id, again)
            if removed.limit(1).count():
                self.tables["symbols"].remove(removed)
        return plan

    def reconcile(self, agent_id: str, local: DataFrame) -> DataFrame:
        return sync.drift(self.passages.where(F.col("agent_id") == agent_id).select("id"), local)

    def grep(self, files: DataFrame, pattern: str, **kw) -> DataFrame:
        return lines.grep(files, pattern, **kw)

    def glob(self, files: DataFrame, extensions: list[str], pattern: str = "**/*", ignore_dirs: list[str] = IGNORE_DIRS) -> DataFrame:
        """``path, truncated`` of files that match."""
        return lines.list_files_marked(files, pattern, extensions, ignore_dirs)

    def read_file(self, files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
        """``content, start_line, end_line, total_lines, truncated`` of a range of lines of one file."""
        found = files.where(F.col("path") == path)
        return found.select(lines.window("content", start, end if end is not None else start + lines.READ_LINES - 1).alias("w")).select("w.*")

    def find_symbol(self, files: DataFrame, name: str, aliases: DataFrame | None = None, **kw) -> DataFrame:
        """Definitions of a name, the most central first."""
        defs, refs = symbols.definitions(files), symbols.references(files)
        aliases = self.spark.createDataFrame([], "ord int, pattern string, target string") if aliases is None else aliases
        ranks = graph.page_rank(graph.symbol_nodes(defs, files), graph.symbol_edges(defs, refs, files, aliases))
        return graph.find_symbols(defs, ranks, name, **kw)

    def index_symbols(self, agent_id: str, files: DataFrame) -> None:
        """Keep the definitions and references of files: a row for each file, which replaces the one before; other files are not parsed again."""
        defs, refs = symbols.definitions(files), symbols.references(files)
        columns = lambda schema: [c.split(":")[0].strip() for c in schema.replace("array<struct<local: string, name: string>>", "x").split(",")]
        lists = [df.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*columns(schema)))).alias(n)) for n, df, schema in (("defs", defs, DEF), ("refs", refs.orderBy("ref_id"), REF))]
        rows = files.select("path").distinct().join(lists[0], "path", "left").join(lists[1], "path", "left")
        empty = lambda n, schema: F.coalesce(F.col(n), F.array()).cast(f"array<struct<{schema}>>").alias(n)  # noqa: E731  # bounded by a file
        self.tables["symbols"].put(rows.select(F.lit(agent_id).alias("agent_id"), "path", empty("defs", DEF), empty("refs", REF)))

    def symbol_tables(self, agent_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Definitions, references and files as they are kept."""
        rows = self.tables["symbols"].read(F.col("agent_id") == agent_id)
        refs = rows.select(F.col("path").alias("of"), F.posexplode("refs").alias("at", "r")).select(F.concat_ws("#", "of", F.col("at").cast("string")).alias("ref_id"), "r.*")
        return rows.select(F.inline("defs")), refs, rows.select("path")

    def symbol_ranks(self, agent_id: str, aliases: DataFrame | None = None) -> DataFrame:
        """``id, rank`` of an agent's symbols and files: the kept ones while no file's symbols changed, else made anew from where the kept ones were."""
        now = (self.tables["symbols"].pointer() or {"version": 0})["version"]
        old = self.tables["ranks"].read(F.col("agent_id") == agent_id).select("id", "rank")
        if self.tables["ranks"].info().get(f"of {agent_id}") == now:
            return old
        defs, refs, files = (kept(df, "symbols") for df in self.symbol_tables(agent_id))
        aliases = self.spark.createDataFrame([], "ord int, pattern string, target string") if aliases is None else aliases
        ranks = graph.page_rank(graph.symbol_nodes(defs, files), graph.symbol_edges(defs, refs, files, aliases), start=kept(old, "old-ranks"))
        gone = kept(old.join(ranks, "id", "left_anti"), "old-ranks")
        if gone.limit(1).count():
            self.tables["ranks"].remove(gone.withColumn("agent_id", F.lit(agent_id)))
        self.tables["ranks"].put(ranks.withColumn("agent_id", F.lit(agent_id)), lambda part: {f"of {agent_id}": now})
        return ranks

    def symbol(self, agent_id: str, name: str, **kw) -> DataFrame:
        """Kept definitions of a name, the most central first; nothing is parsed."""
        return graph.find_symbols(self.symbol_tables(agent_id)[0], self.symbol_ranks(agent_id), name, **kw)

    def stats(self) -> DataFrame:
        """``agent_id, name, passages, files, blocks`` of each agent."""
        passages = self.passages.groupBy("agent_id").agg(F.count("*").alias("passages"), F.countDistinct("file_path").alias("files"))
        blocks = self.blocks.groupBy("agent_id").agg(F.count("*").alias("blocks"))
        out = self.agents.select("agent_id", "name").join(passages, "agent_id", "left").join(blocks, "agent_id", "left")
        return out.na.fill(0, ["passages", "files", "blocks"])

    def status(self, agent_id: str | None = None) -> DataFrame:
        """Counts, block sizes and times of one agent or all, with a report for readers."""
        out = sync.status(self.agents, self.passages, self.blocks, self.state)
        return out if agent_id is None else out.where(F.col("agent_id") == agent_id)

    def export(self, path: str | None = None) -> DataFrame:
        """``agent_id, markdown`` of every agent; written as JSON lines where a path is given."""
        out = sources.export_text(self.blocks, self.passages)
        if path:
            out.write.json(path)
        return out

    def check(self, configured: DataFrame) -> DataFrame:
        """``repo, issue`` where configuration (``repo``), agents and passages disagree."""
        agents, stored = self.agents.select(F.col("agent_id").alias("repo")), self.passages.select(F.col("agent_id").alias("repo"))
        return sync.consistency(configured, agents, stored)

    def stream(self, agent_id: str, events: DataFrame, files: Callable[[], DataFrame], checkpoint: str, **kw):
        """Keep an agent in step with a stream of ``repo, path`` events; ``files`` gives ``path, content, size_kb`` as they are."""

        def apply(changed: DataFrame, number: int) -> None:
            self.sync(agent_id, changed.where(F.col("repo") == agent_id).select("path").distinct(), files())

        return watch.watch(events, apply, checkpoint, **kw)

    def watch(self, repos: dict[str, str], files: Callable[[str], DataFrame], checkpoint: str, events: DataFrame | None = None, include: Callable | None = None, ignore: list[str] | None = None, **options):
        """Keep agents in step with the commits of their checked-out folders, and with ``events`` (``repo, path``) where given.

        Commits are read from the one of the last sync on. What is due is applied repository by repository; a failure makes its
        repository wait, longer each time, and is tried again. Repositories without an agent are left alone.
        """
        known = {r.agent_id for r in self.agents.where(F.col("agent_id").isin(list(repos))).collect()}
        state = self.state.where(F.col("agent_id").isin(sorted(known)) & F.col("last_sync_commit").isNotNull())
        since = {r.agent_id: r.last_sync_commit for r in state.collect()}
        stream = live.events_of(changes.changes(self.spark, {r: f for r, f in repos.items() if r in known}, since, ignore), include=include)
        if events is not None:
            stream = stream.unionByName(live.events_of(events.where(F.col("repo").isin(sorted(known))), ignore, include))

        def apply(repo: str, changed: DataFrame, number: int) -> None:
            head = git.head(repos[repo])
            self.sync(repo, changed, files(repo))
            self.save_state(repo, last_sync_commit=head, last_sync_at=datetime.now(UTC).isoformat(timespec="milliseconds"))

        return live.watch_live(stream, apply, checkpoint, **options)

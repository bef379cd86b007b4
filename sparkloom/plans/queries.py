"""Registered queries over the driver's tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, sql, text
from ..operators import chunking, evaluate, graph, inverted, lines, pivots, search, sync
from ..sources import files as repositories
from ..storage import kept, shared_root
from ..streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}

# documents stand for the files of repositories: their source is the repository, their language the kind of file
_EXT = {"en": ".ts", "de": ".py", "fr": ".go", "es": ".md"}
_DIR = {"src1": "pkg/tests", "src2": "node_modules/pkg", "src3": "src/__tests__", "src4": "pkg/core", "src5": "pkg"}
_PATH_SQL = (
    "(case source " + " ".join(f"when '{s}' then '{d}'" for s, d in _DIR.items()) + " else 'src/' || source end || '/' || lang || case lang when 'fr' then '_test' else '' end || '_' || doc_id || "
    "case lang when 'fr' then '_test' else '' end || case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in _EXT.items()) + " else '.txt' end)"
)
FILES_SQL = f"(select doc_id, source, {_PATH_SQL} as path, text as content, n_chars / 1024.0 as size_kb from documents)"
PASSAGES_SQL = f"(select doc_id as id, 'FILE: ' || path || ' | FUNCTION: f' || case source when 'src6' then ' (continued)' else '' end || chr(10) || chr(10) || content as text from {FILES_SQL} f0)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, path, content, size_kb`` of documents as files."""
    docs = table(spark, sf_dir, "documents")
    folder = F.coalesce(F.create_map(*[F.lit(x) for kv in _DIR.items() for x in kv])[F.col("source")], F.concat(F.lit("src/"), "source"))
    ext = F.coalesce(F.create_map(*[F.lit(x) for kv in _EXT.items() for x in kv])[F.col("lang")], F.lit(".txt"))
    mark = F.when(F.col("lang") == "fr", "_test").otherwise("")
    path = F.concat(folder, F.lit("/"), "lang", mark, F.lit("_"), F.col("doc_id").cast("string"), mark, ext)
    return docs.select("doc_id", "source", path.alias("path"), F.col("text").alias("content"), (F.col("n_chars") / 1024.0).alias("size_kb"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of documents as passages with a header."""
    mark = F.when(F.col("source") == "src6", text.CONTINUED).otherwise("")
    return files(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("FILE: "), "path", F.lit(" | FUNCTION: f"), mark, F.lit("\n\n"), "content").alias("text"))


# --- predicates and text ------------------------------------------------------------------------------

_EXTENSIONS, _IGNORED = [".ts", ".py", ".md"], ["node_modules", "dist"]


@query(f"select path, regexp_extract(path, '(\\.[^.]*)$', 1) in ('.ts', '.py', '.md') and size_kb <= 4 and not list_contains(string_split(path, '/'), 'node_modules') and not list_contains(string_split(path, '/'), 'dist') as included from {FILES_SQL} f")
def file_filter(spark, sf_dir):
    return files(spark, sf_dir).select("path", paths.include_file("path", "size_kb", _EXTENSIONS, _IGNORED, 4).alias("included"))


@query(
    f"""select path, regexp_matches(path, '(Test|Tests|Spec|Specs)\\.(java|cs|kt|kts|scala)$') or regexp_matches(lower(path), '(^|/)(__tests__|__test__|tests?|specs?)/')
or regexp_matches(lower(path), '\\.(test|spec|e2e)\\.[^/]*$') or regexp_matches(lower(path), '_test\\.[a-z0-9]+$') or regexp_matches(lower(path), '(^|/)test_[^/]*\\.py$') or regexp_matches(lower(path), '(^|/)conftest\\.py$') as is_test from {FILES_SQL} f"""
)
def test_path_flag(spark, sf_dir):
    return files(spark, sf_dir).select("path", paths.test_path("path").alias("is_test"))


@query(f"select path, case when starts_with(path, 'pkg/') then substr(path, 5) end as agent_path from {FILES_SQL} f")
def agent_path(spark, sf_dir):
    return files(spark, sf_dir).select("path", paths.agent_path("path", "./pkg/").alias("agent_path"))


_IGNORE_LINES = ["# generated", "*.md", "!en_*", "/src/src7/*", "!/src/src7/de*", "node_modules/", "pkg/t?sts/*.py", "__tests__"]


@query(
    f"""select path, case when list_contains(string_split(path, '/'), '__tests__') then true when regexp_matches(path, '^pkg/t.sts/.*\\.py$') then true
when list_contains(string_split(path, '/'), 'node_modules') then true when regexp_matches(path, '^src/src7/de.*$') then false when regexp_matches(path, '^src/src7/.*$') then true
when regexp_matches(path, '(^|/)en_[^/]*(/|$)') then false when regexp_matches(path, '\\.md$') then true else false end as ignored from {FILES_SQL} f"""
)
def gitignore_match(spark, sf_dir):
    rules = spark.createDataFrame(list(enumerate(_IGNORE_LINES)), "line_no int, pattern string")
    return lines.gitignored(files(spark, sf_dir), rules)


@query(f"select path from {FILES_SQL} f where path ilike 'SRC/src1_/%'")
def prefix_filter(spark, sf_dir):
    return files(spark, sf_dir).where(paths.like_prefix("path", "SRC/src1_/")).select("path")


@query(
    f"""select path as source_path, i::int as chunk_no, regexp_replace(case when i = 0 then 'FILE: ' || path else 'FILE: ' || path || ' (continued)' end || chr(10) || chr(10) ||
substr(content, case when i = 0 then 1 else a + (i - 1) * (a - 12) + 1 end, case when i = 0 then a else a - 12 end), '\\s+$', '') as text
from (select path, content, a, unnest(generate_series(0, ceil(greatest(length(content) - a, 0) / (a - 12)::double)::bigint)) as i from (select path, content, 2000 - length(path) - 8 as a from {FILES_SQL} f where regexp_matches(content, '\\S')) x) y"""
)
def raw_chunks(spark, sf_dir):
    return chunking.chunks(files(spark, sf_dir))


@query(SQL["raw_chunks"])
def sql_chunks(spark, sf_dir):
    """As ``raw_chunks``, in plain SQL."""
    sql.register(spark)
    return spark.sql("select source_path, chunk_no, text from chunk_files(table({files}), 2000)", files=files(spark, sf_dir).select("path", "content"))


@query(
    f"""with p as (select id, text, split_part(text, chr(10), 1) as line from {PASSAGES_SQL} p0)
select id, regexp_replace(substr(line, 7), ' \\(continued\\)$', '') as source_path, split_part(substr(line, 7), ' | ', 1) as budget_path, split_part(regexp_replace(substr(line, 7), ' \\(continued\\)$', ''), ' | ', 1) as clean_path,
case when length(b) > 160 then substr(b, 1, 160) || '…' else b end as snippet from (select *, trim(regexp_replace(substr(text, length(line) + 2), '\\s+', ' ', 'g')) as b from p) q"""
)
def passage_paths(spark, sf_dir):
    return passages(spark, sf_dir).select("id", text.source_path("text").alias("source_path"), text.budget_path("text").alias("budget_path"), text.clean_path("text").alias("clean_path"), text.snippet("text").alias("snippet"))


@query("select doc_id, case when length(text) + 8 + 21 <= 2000 then 'FILE: x' || chr(10) || 'CONTEXT | imports: a' || chr(10) || text else 'FILE: x' || chr(10) || text end as enriched from documents")
def enriched_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.enriched(F.concat(F.lit("FILE: x\n"), "text"), F.lit("CONTEXT | imports: a")).alias("enriched"))


@query("select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 as lines, 1 + length(substr(text, 1, 200)) - length(replace(substr(text, 1, 200), chr(10), '')) as line_of_200, sha256(text) as hash from documents")
def line_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.line_at("text", F.length("text")).cast("long").alias("lines"), text.line_at("text", F.lit(200)).cast("long").alias("line_of_200"), text.content_hash("text").alias("hash"))


@query(
    """with w as (select doc_id, substr(t, 1, 4) as s from (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) as t from documents) x where t <> ''),
h as (select doc_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(s, ''), lambda c: ascii(c)::bigint)), lambda a, b: (a * 31 + b) % 4294967296) % 64 as slot from w),
c as (select doc_id, slot, count(*)::double as n from h group by all)
select doc_id, slot::int as slot, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as value from c"""
)
def stub_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.stub_embedding("text").alias("v"))
    return docs.select("doc_id", F.posexplode("v").alias("slot", "value")).where("value > 0").withColumn("value", F.round("value", 6))


@query(SQL["stub_embedding"])
def sql_embedding(spark, sf_dir):
    """As ``stub_embedding``, in plain SQL."""
    sql.register(spark)
    return spark.sql("select doc_id, slot, round(value, 6) as value from {docs} lateral view posexplode(stub_embedding(text)) v as slot, value where value > 0", docs=table(spark, sf_dir, "documents"))


@query("select user_id, n::int as n, case when n <= 0 then 0.0 else least(5000 * pow(2, n - 1), 300000.0) end as wait from (select user_id, count(*) filter (event_type = 'error') % 12 as n from events group by user_id) e")
def backoff_waits(spark, sf_dir):
    errors = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") % 12).cast("int").alias("n"))
    return errors.select("user_id", "n", text.backoff(F.lit(5000), F.col("n")).alias("wait"))


# --- lines and windows ---------------------------------------------------------------------------------


@query(
    f"""select path, line, text from (select path, line, text, row_number() over (partition by path order by line) as n from (select path, i::int as line, l[i] as text from (select path, l, unnest(generate_series(1, len(l))) as i from (select path, string_split(content, chr(10)) as l from {FILES_SQL} f) a) b) c
where regexp_matches(text, '(?i)licen[cs]ed?\\b')) d where n <= 2"""
)
def grep_lines(spark, sf_dir):
    return lines.grep(files(spark, sf_dir), r"licen[cs]ed?\b", ignore_case=True, per_file=2)


@query(
    f"""with l as (select path, string_split(content, chr(10)) as l from {FILES_SQL} f), w as (select path, len(l)::int as total_lines, least(2, len(l))::int as a, least(greatest(least(2, len(l)), 4), len(l))::int as b, l from l),
c as (select path, total_lines, a, b, array_to_string(l[a:b], chr(10)) as t from w), p as (select *, substr(t, 1, 299) as x from c)
select path, a as start_line, total_lines, length(t) > 300 as truncated, case when length(t) <= 300 then t when contains(x, chr(10)) then regexp_extract(x, '^([\\s\\S]*)\\n[^\\n]*$', 1) || '…' else x || '…' end as content,
(case when length(t) <= 300 then b when contains(x, chr(10)) then a + len(string_split(regexp_extract(x, '^([\\s\\S]*)\\n[^\\n]*$', 1), chr(10))) - 1 else a end)::int as end_line from p"""
)
def read_window(spark, sf_dir):
    return files(spark, sf_dir).select("path", lines.window("content", 2, 4, 300).alias("w")).select("path", "w.*")


@query(f"select path from {FILES_SQL} f where regexp_matches(path, '^pkg/(?:[^/]+/)*en_[^/]*\\.ts$') and size_kb <= 1024 order by path limit 200")
def glob_list(spark, sf_dir):
    return lines.list_files(files(spark, sf_dir), "pkg/**/en_*.ts", _EXTENSIONS, _IGNORED)


@query(
    """with m as (select conv_id, turn, 'see `src/' || role || '.py` and `path/to/src/user.py`' || chr(10) || text as t, role from conversations),
k as (select * from (values ('src/user.py')) v(path))
select conv_id, turn, case when role = 'user' then 'see `src/user.py` and `src/user.py`' || chr(10) || substr(t, strpos(t, chr(10)) + 1) else substr(t, strpos(t, chr(10)) + 1) end as text, true as changed, case when role = 'user' then '' else 'src/' || role || '.py' end as dropped from m"""
)
def grounding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    texts = c.select(F.struct("conv_id", "turn").alias("id"), F.concat(F.lit("see `src/"), "role", F.lit(".py` and `path/to/src/user.py`\n"), "text").alias("text"))
    known = spark.createDataFrame([("src/user.py",)], "path string")
    out = lines.grounded(texts, known)
    return out.select("id.conv_id", "id.turn", "text", "changed", F.array_join("dropped", ",").alias("dropped"))


@query(
    """with i as (select user_id, (epoch(ts) / 60)::bigint as s, (epoch(ts) / 60)::bigint + 1 + floor(abs(value))::bigint as e from (select user_id, floor(epoch(ts) / 60) * 60 as ts0, ts, value from events) x),
o as (select *, case when max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as n from i),
g as (select *, sum(n) over (partition by user_id order by s, e rows between unbounded preceding and current row) as k from o)
select user_id, min(s) as start, max(e) as "end" from g group by user_id, k""".replace("(epoch(ts) / 60)::bigint", "floor(epoch(ts) / 60)::bigint")
)
def interval_merge(spark, sf_dir):
    return chunking.merge_intervals(_intervals(spark, sf_dir), ["user_id"])


def _intervals(spark, sf_dir):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    return table(spark, sf_dir, "events").select("user_id", minute.alias("start"), (minute + 1 + F.floor(F.abs("value"))).alias("end"))


@query(
    f"""with m as ({SQL["interval_merge"]}), t as (select user_id, max("end") + 10 as n from m group by user_id),
a as (select user_id, start as s, "end" as e from m union all select user_id, n, n from t), l as (select user_id, coalesce(lag(e) over (partition by user_id order by s, e), 0) as start, s as "end" from a) select * from l where start < "end" """
)
def gaps(spark, sf_dir):
    merged = interval_merge(spark, sf_dir)
    lengths = merged.groupBy("user_id").agg((F.max("end") + 10).alias("length"))
    return chunking.gaps(merged, lengths, ["user_id"])


# --- search --------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(strip_accents(lower(text)), '([\\p{{L}}\\p{{N}}_]+)', 1)"
_BM25 = f"""d as (select id, text, {_TOK} as t from {{passages}} p), st as (select count(*)::double as n, avg(len(t)) as a from d),
post as (select id, term, dl, count(*) as tf from (select id, len(t) as dl, unnest(t) as term from d) x group by all),
qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '(\\w+)', 1)) as term from benchmark) x group by all),
df as (select term, count(*) as df from post group by term),
qi as (select query_id, qt.term, qtf, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from qt join df using (term), st),
sc as (select query_id, id, sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) as score from post join qi using (term), st group by all),
lex as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from sc qualify rank <= {{k}})"""
_VEC = """q as (select b.item_id as query_id, e.embedding as v from benchmark b join embeddings e on e.vec_id = b.item_id),
vec as (select query_id, vec_id as id, list_cosine_similarity(embedding::double[], v::double[]) as score, row_number() over (partition by query_id order by round(list_cosine_similarity(embedding::double[], v::double[]), 9) desc, vec_id) as rank from embeddings, q qualify rank <= {k})"""
_RRF = """al as (select query_id, id, 2.0 / (10 + rank) as part, rank as seen from vec union all select query_id, id, 1.0 / (10 + rank), 4294967296 + rank from lex where query_id in (select query_id from vec)),
fu as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 12) desc, seen) as rank from (select query_id, id, sum(part) as score, min(seen) as seen from al group by all) x)"""
_DOCS = "(select doc_id as id, text from documents)"


def _vectors(spark, sf_dir, items):
    """All vectors, and those that stand for the queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors, items.select("query_id").join(vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def _legs(spark, sf_dir, limit, source=None):
    k = search.candidates(limit)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors, asked = _vectors(spark, sf_dir, items)
    docs = source if source is not None else table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return kept(search.vector_top_k(vectors, asked, k), "vector-leg"), kept(_index(docs).bm25(items, k), "lexical-leg")


def _index(docs):
    """An inverted index of ``id, text`` among the intermediate tables."""
    return inverted.InvertedIndex.write(docs, f"{shared_root(docs.sparkSession)}/index-{uuid.uuid4().hex}")


def _ranked(df):
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("with " + _VEC.format(k=15) + " select query_id, id, round(score, 6) as score, rank from vec")
def vector_topk(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return _ranked(search.vector_top_k(*_vectors(spark, sf_dir, items), search.candidates(5)))


@query(SQL["vector_topk"])
def vector_topk_pivots(spark, sf_dir):
    """As ``vector_topk``, by an index of cells around pivots."""
    vectors, asked = _vectors(spark, sf_dir, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")))
    index = pivots.PivotIndex.write(vectors, f"{shared_root(spark)}/pivots-{uuid.uuid4().hex}")
    return _ranked(index.top_k(asked, search.candidates(5)))


@query("with " + _BM25.format(passages=_DOCS, k=15) + " select query_id, id, round(score, 6) as score, rank from lex")
def bm25_topk(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark")
    return _ranked(_index(docs).bm25(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), search.candidates(5)))


@query("with " + ", ".join([_BM25.format(passages=_DOCS, k=15), _VEC.format(k=15), _RRF]) + " select query_id, id, round(score, 6) as score, rank from fu")
def rrf_fused(spark, sf_dir):
    vector, lexical = _legs(spark, sf_dir, 5)
    return _ranked(search.hybrid(vector, lexical, 1 << 30))


@query("with " + ", ".join([_BM25.format(passages=_DOCS, k=30), _VEC.format(k=30), _RRF]) + " select query_id, id, round(score, 6) as score, rank from fu where rank <= 10")
def hybrid_search(spark, sf_dir):
    vector, lexical = _legs(spark, sf_dir, 10)
    return _ranked(search.hybrid(vector, lexical, 10))


@query(
    "with " + ", ".join([_BM25.format(passages=_DOCS, k=15), _VEC.format(k=15), _RRF])
    + """ select 'fused' as leg, query_id, id, round(score, 6) as score, rank from fu where rank <= 5 union all select 'vector', query_id, id, round(1.0 / (60 + rank), 6), rank from vec where rank <= 5 union all select 'lexical', query_id, id, round(1.0 / (60 + rank), 6), rank from lex where rank <= 5"""
)
def search_legs(spark, sf_dir):
    vector, lexical = _legs(spark, sf_dir, 5)
    return search.legs(vector, lexical, 5).select("leg", "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_TOOL = (
    "with " + ", ".join([_BM25.format(passages=PASSAGES_SQL, k=30), _VEC.format(k=30), _RRF])
    + f""", hit as (select fu.query_id, fu.id, fu.score, fu.rank, p.text, split_part(substr(split_part(p.text, chr(10), 1), 7), ' | ', 1) as path from fu join {PASSAGES_SQL} p on p.id = fu.id where rank <= 10),
one as (select *, row_number() over (partition by query_id, path order by rank) as n from hit), kept as (select *, row_number() over (partition by query_id order by rank) as place from one where n <= 2 qualify place <= 5),
flag as (select *, regexp_matches(lower(path), '(^|/)(__tests__|__test__|tests?|specs?)/') or regexp_matches(lower(path), '_test\\.[a-z0-9]+$') as test from kept)
select query_id, id, path as file_path, length(text) > 1200 as truncated, case when length(text) > 1200 then substr(text, 1, 1199) || '…' else text end as text, """
)


@query(_TOOL + "place::bigint as place from kept")
def budgeted(spark, sf_dir):
    return _tool(spark, sf_dir).select("query_id", "id", "file_path", "truncated", "text", F.col("place").cast("long").alias("place"))


@query(_TOOL + "row_number() over (partition by query_id order by test, place) as position from flag")
def demoted(spark, sf_dir):
    return _tool(spark, sf_dir).select("query_id", "id", "file_path", "truncated", "text", F.col("position").cast("long").alias("position"))


def _tool(spark, sf_dir):
    source = passages(spark, sf_dir)
    vector, lexical = _legs(spark, sf_dir, 10, source)
    return search.tool_search(vector, lexical, source, 5)


# --- evaluation ----------------------------------------------------------------------------------------

_RUN = """run as (select 'fused' as leg, source as query_id, doc_id::varchar as path, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents union all
select 'vector', source, doc_id::varchar, row_number() over (partition by source order by n_chars, doc_id) from documents union all select 'lexical', source, doc_id::varchar, row_number() over (partition by source order by doc_id) from documents),
gold as (select source as query_id, case when source < 'src15' then 'identifier' when source < 'src2' then 'paraphrase' else 'no-term' end as kind, doc_id::varchar as path from documents join labels using (doc_id) where quality = 0),
m as (select leg, g.query_id, g.kind, count(distinct case when rank <= 1 then path end) / max(n)::double as recall_1, count(distinct case when rank <= 5 then path end) / max(n)::double as recall_5, coalesce(1.0 / min(rank), 0) as rr
from (select query_id, kind, count(*) as n from gold group by all) g join run using (query_id) join gold using (query_id, path) group by all)"""


def _run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    orders = {"fused": [F.desc("n_chars"), F.col("doc_id")], "vector": [F.col("n_chars"), F.col("doc_id")], "lexical": [F.col("doc_id")]}
    run = None
    for leg, order in orders.items():
        one = docs.select(F.lit(leg).alias("leg"), F.col("source").alias("query_id"), F.row_number().over(Window.partitionBy("source").orderBy(*order)).alias("rank"), F.col("doc_id").cast("string").alias("path"))
        run = one if run is None else run.unionByName(one)
    kind = F.when(F.col("source") < "src15", "identifier").when(F.col("source") < "src2", "paraphrase").otherwise("no-term")
    gold = docs.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select(F.col("source").alias("query_id"), kind.alias("kind"), F.col("doc_id").cast("string").alias("path"))
    return evaluate.query_metrics(run, gold)


_METRICS = ["recall_1", "recall_5", "rr"]


@query(f"with {_RUN} select leg, query_id, kind, round(recall_1, 6) as recall_1, round(recall_5, 6) as recall_5, round(rr, 6) as rr from m")
def recall_mrr(spark, sf_dir):
    return _run(spark, sf_dir).select("leg", "query_id", "kind", *[F.round(c, 6).alias(c) for c in _METRICS])


@query(f"with {_RUN} select leg, kind, round(avg(recall_1), 6) as recall_1, round(avg(recall_5), 6) as recall_5, round(avg(rr), 6) as rr from m group by grouping sets ((leg, kind), (leg))")
def metrics_rollup(spark, sf_dir):
    return _report(spark, sf_dir).select("leg", "kind", *[F.round(c, 6).alias(c) for c in _METRICS])


def _report(spark, sf_dir):
    m = _run(spark, sf_dir)
    return m.groupBy("leg").agg(*[F.avg(c).alias(c) for c in _METRICS]).withColumn("kind", F.lit(None).cast("string")).unionByName(m.groupBy("leg", "kind").agg(*[F.avg(c).alias(c) for c in _METRICS]))


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, count(*) as n from events group by event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluate.percentile("value", 50).alias("p50"), evaluate.percentile("value", 95).alias("p95"), F.count("*").alias("n"))


@query(
    f"""with {_RUN}, r as (select leg, avg(recall_1) as recall_1, avg(recall_5) as recall_5, avg(rr) as rr from m group by leg), u as (unpivot r on recall_1, recall_5, rr into name metric value v)
select b.metric, round(b.v, 6) as base, round(n.v, 6) as now, round(n.v - b.v, 6) as delta, n.v - b.v < -0.02 as regressed from u b join u n using (metric) where b.leg = 'fused' and n.leg = 'lexical'"""
)
def report_delta(spark, sf_dir):
    report = _report(spark, sf_dir).where("kind is null").select("leg", *_METRICS)
    at = lambda leg: report.where(F.col("leg") == leg).select(F.lit(1).alias("k"), *_METRICS)
    out = evaluate.compare(at("fused"), at("lexical"), ["k"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("base", "now", "delta")], "regressed")


@query(
    f"""with {_RUN}, r as (select leg, kind, avg(recall_1) as recall_1, avg(recall_5) as recall_5, avg(rr) as rr from m group by grouping sets ((leg, kind), (leg))),
g as (select 'identifier fused R@1' as gate, (select recall_1 from r where leg = 'fused' and kind = 'identifier') as value, 1.0 as required union all
select 'fused R@5 >= vector R@5', (select recall_5 from r where leg = 'fused' and kind is null), (select recall_5 from r where leg = 'vector' and kind is null) union all
select 'fused MRR >= best leg', (select rr from r where leg = 'fused' and kind is null), (select max(rr) - 0.05 from r where leg in ('vector', 'lexical') and kind is null) union all
select 'paraphrase fused R@1', (select recall_1 from r where leg = 'fused' and kind = 'paraphrase'), 0.2 union all select 'no-term fused R@5', (select recall_5 from r where leg = 'fused' and kind = 'no-term'), 0.2)
select gate, round(value, 6) as value, round(required, 6) as required, value >= required - 1e-9 as passed from g where value is not null"""
)
def quality_gates(spark, sf_dir):
    return evaluate.gates(_report(spark, sf_dir)).select("gate", F.round("value", 6).alias("value"), F.round("required", 6).alias("required"), "passed")


@query("select conv_id, turn, (contains(lower(text), 'the') and contains(lower(text), 'a')) and not contains(lower(text), 'ß') as passed from conversations")
def answer_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.array(F.lit("The"), F.lit("a")).alias("must_include"), F.array(F.lit("ß")).alias("must_not_include"))
    return evaluate.answer_checks(c).select("conv_id", "turn", "passed")


# --- synchronisation -----------------------------------------------------------------------------------

# the second version of a file: those of src8 are gone, those of src9 have a line more, those of src10 are too large
_NOW_SQL = f"(select path, case source when 'src9' then content || chr(10) else content end as content, case source when 'src10' then 4096.0 else size_kb end as size_kb from {FILES_SQL} f where source <> 'src8')"


def _now(spark, sf_dir):
    f = files(spark, sf_dir).where("source <> 'src8'")
    changed = F.when(F.col("source") == "src9", F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
    return f.select("path", changed.alias("content"), F.when(F.col("source") == "src10", 4096.0).otherwise(F.col("size_kb")).alias("size_kb"))


@query(f"select path, sha256(content) as sha256 from {FILES_SQL} f")
def content_hash(spark, sf_dir):
    return sync.content_hashes(files(spark, sf_dir))


@query(
    f"""select f.path, case when n.path is null or n.size_kb > 1024 then 'removed' when sha256(n.content) = sha256(f.content) then 'unchanged' else 'reindexed' end as action,
case when n.size_kb <= 1024 then sha256(n.content) end as sha256 from {FILES_SQL} f left join {_NOW_SQL} n on n.path = f.path"""
)
def hash_diff(spark, sf_dir):
    old = files(spark, sf_dir)
    return sync.hash_diff(old.select("path"), _now(spark, sf_dir), sync.content_hashes(old))


_MAP_SQL = f"(select source as repo, path, doc_id::varchar as passage_id, doc_id as pos from {FILES_SQL} f)"


def _map(spark, sf_dir):
    return files(spark, sf_dir).select(F.col("source").alias("repo"), "path", F.col("doc_id").cast("string").alias("passage_id"), F.col("doc_id").alias("pos"))


@query(f"select path, passage_id, n_files, is_full from {_MAP_SQL} m, (select count(*) as n_files, count(*) > 500 as is_full from {FILES_SQL} f where source >= 'src5') c where repo >= 'src5'")
def sync_plan(spark, sf_dir):
    old, plan = sync.sync_plan(files(spark, sf_dir).where("source >= 'src5'"), _map(spark, sf_dir))
    row = plan.first()
    return old.withColumn("n_files", F.lit(row.n_files)).withColumn("is_full", F.lit(row.is_full))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def dedupe_latest(spark, sf_dir):
    return sync.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("select * from (select doc_id as id from documents except select doc_id from labels) x")
def reconcile_orphans(spark, sf_dir):
    return sync.orphans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("select * from (select doc_id as id from labels where quality = 0 except select doc_id from documents where lang = 'en') x")
def reconcile_missing(spark, sf_dir):
    return sync.missing(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id")))


@query("select (select count(*) from (select doc_id from documents except select doc_id from labels)) as orphans, (select count(*) from (select doc_id from labels except select doc_id from documents)) as missing, false as in_sync")
def drift_summary(spark, sf_dir):
    return sync.drift(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query(f"select repo as path, string_agg(passage_id, ',' order by pos) as ids from {_MAP_SQL} m where pos not in (select doc_id from labels) group by repo")
def clean_map(spark, sf_dir):
    lost = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    by_repo = _map(spark, sf_dir).select(F.col("repo").alias("path"), "pos", "passage_id")
    return sync.cleaned_map(by_repo, lost).select("path", F.array_join("ids", ",").alias("ids"))


@query("select lang as repo, 'state without configuration' as issue from (select distinct lang from documents) d where lang not in ('en', 'xx') union all select 'xx', 'configuration without state' union all select lang, 'state without store' from (select distinct lang from documents where lang not in (select lang from documents join labels using (doc_id) where toxic = 1)) e")
def consistency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return sync.consistency(spark.createDataFrame([("en",), ("xx",)], "repo string"), docs.select(F.col("lang").alias("repo")), toxic.select(F.col("lang").alias("repo")))


@query(
    """with x as (select c_custkey as id, 0 as v, c_name as name, c_custkey as seq from customer), b as (select c_custkey as id, 1 as v, c_mktsegment as name, row_number() over (order by c_custkey) as seq from customer where c_acctbal < 0), t as (select max(seq) as top from x)
select id, name, seq from x where id not in (select id from b) union all select id, name, top + seq from b, t"""
)
def upsert_passages(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    store = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    batch = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.row_number().over(Window.orderBy("c_custkey")).cast("long").alias("seq"))
    return sync.upsert(store, batch, ["id"])


@query("select source, sha256(string_agg(lang || chr(0) || n || chr(0), '' order by lang)) as fingerprint from (select source, lang, count(*)::varchar as n from documents group by all) d group by source")
def block_fingerprint(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("label")).agg(F.count("*").cast("string").alias("value"))
    return sync.fingerprint(blocks, ["source"])


@query(
    """with a as (select c_mktsegment as label, count(*) as v from customer group by 1), b as (select c_mktsegment as label, count(*) filter (c_acctbal >= 0 or c_mktsegment like 'A%') as v from customer group by 1)
select label, a.v is distinct from b.v as changed from a full join b using (label)"""
)
def changed_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("value"))
    b = c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count_if((F.col("c_acctbal") >= 0) | F.col("c_mktsegment").startswith("A")).alias("value"))
    return sync.changed_blocks(a, b)


@query(
    """select s_suppkey, case when s_acctbal < 0 then 'create' when s_nationkey = 3 then 'reindex_full' when s_acctbal < 2000 then 'resume_full' when s_acctbal < 4000 then 'resume_bootstrap' else 'skip' end as mode,
case when s_nationkey < 5 then 'range:' || s_name when s_nationkey < 10 then 'since:' || s_name else 'recent:20' end as evidence from supplier"""
)
def setup_modes(spark, sf_dir):
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    mode = sync.setup_mode(F.lit(True), b >= 2000, b >= 4000, b >= 0, n == 3)
    evidence = sync.evidence_source(F.when(n < 5, F.col("s_name")), F.lit(True), F.when(n < 10, F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", mode.alias("mode"), evidence.alias("evidence"))


@query(
    f"""select ext, n from (select regexp_extract(path, '(\\.[^.]*)$', 1) as ext, count(*) as n, min(doc_id) as f from {FILES_SQL} x group by 1) y order by n desc, f limit 10"""
)
def extension_histogram(spark, sf_dir):
    return sync.extension_histogram(files(spark, sf_dir).withColumn("pos", F.col("doc_id")))


@query(f"select distinct d as dir from (select unnest(string_split(path, '/')) as d from {FILES_SQL} f) x where d in ('node_modules', 'dist', 'build', 'vendor', 'target', 'out')")
def suggested_ignores(spark, sf_dir):
    return sync.suggested_ignores(files(spark, sf_dir))


@query(f"select repo, count(distinct path) as files, count(passage_id) as passages, coalesce(max(s.n), 0) as stored, coalesce(max(s.n), 0) - count(passage_id) as drift from {_MAP_SQL} m left join (select source, count(*) as n from documents join labels using (doc_id) group by 1) s on s.source = repo group by repo")
def agent_stats(spark, sf_dir):
    store = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("repo"))
    return sync.agent_stats(_map(spark, sf_dir), store)


@query(
    """with r as (select conv_id, turn, text, sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and current row) <= 1501 as fits from conversations)
select conv_id, turn, omitted::bigint as omitted from (select *, count(*) filter (not fits) over (partition by conv_id) as omitted from r) x where fits"""
)
def commit_budget_prefix(spark, sf_dir):
    out = sync.commit_prefix(table(spark, sf_dir, "conversations"), 1500, ["conv_id"], "turn")
    return out.select("conv_id", "turn", "omitted")


@query(
    f"""select source, string_agg('- ' || path, chr(10) order by path) || case when max(t) > 10 then chr(10) || '…and ' || (max(t) - 10) || ' more' else '' end as lines
from (select source, path, row_number() over (partition by source order by path) as n, count(*) over (partition by source) as t from {FILES_SQL} f) x where n <= 10 group by source"""
)
def capped_paths(spark, sf_dir):
    return sync.capped_paths(files(spark, sf_dir), ["source"], 10)


# --- graphs --------------------------------------------------------------------------------------------

_STEPS = 10
_EDGES_SQL = "edge as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem where l_returnflag = 'R'), node as (select 's' || s_suppkey as id from supplier union all select 'p' || p_partkey from part), deg as (select src, count(*)::double as d from edge group by src), n as (select count(*)::double as n from node), r0 as (select id, 1.0 / n as rank from node, n)"


def _rank_sql():
    steps = [_EDGES_SQL]
    for i in range(1, _STEPS + 1):
        p = f"r{i - 1}"
        steps.append(
            f"g{i} as (select dst as id, sum(rank / d) as got from edge join {p} on {p}.id = src join deg using (src) group by dst), "
            f"x{i} as (select coalesce(sum(rank), 0) as dang from {p} where id not in (select src from edge)), "
            f"r{i} as (select {p}.id, 0.15 / n + 0.85 * dang / n + 0.85 * coalesce(got, 0) as rank from {p} left join g{i} using (id), x{i}, n)"
        )
    return f"with {', '.join(steps)} select id, round(rank * 1000, 6) as rank from r{_STEPS}"


@query(_rank_sql())
def pagerank(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = item.select(s.alias("src"), p.alias("dst")).union(item.where("l_returnflag = 'R'").select(p, s))
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return graph.page_rank(nodes, edges, iterations=_STEPS, tolerance=0.0, once=True).select("id", F.round(F.col("rank") * 1000, 6).alias("rank"))


_SOURCES = [
    ("src/a.ts", "import { helper as h } from './lib/b';\nimport * as all from '@app/c';\nimport def from './d';\nexport function run() { h(); all.deep(); def(); local(); }\nfunction local() {}\n"),
    ("src/lib/b.ts", "export function helper() { other(); }\nexport const other = () => 1;\n"),
    ("src/c/index.ts", "export function deep() {}\nfunction hidden() {}\n"),
    ("src/d.js", "export default class Thing {\n  go() { return this.stop(); }\n  stop() {}\n}\n"),
    ("svc/main.py", "from . import util\nfrom .util import load\n\n\nclass App:\n    def start(self):\n        load()\n        util.save()\n"),
    ("svc/util.py", "def load():\n    pass\n\n\ndef save():\n    load()\n"),
]


def fixture(spark):
    """``path, content`` of a few source files in three languages, for tests."""
    return spark.createDataFrame(_SOURCES, "path string, content string")


# suppliers, customers and nations as source files: a supplier is a Python module and a customer a TypeScript one; both use
# their nation's module
_CODE_SQL = """code as (select 'svc/s' || s_suppkey || '.py' as path, 'svc/n' || s_nationkey || '.py' as uses, 'from .n' || s_nationkey || ' import load' || chr(10) || chr(10) || chr(10) || 'def run():' || chr(10) || '    load()' || chr(10) as content from supplier
union all select 'src/c' || c_custkey || '.ts', 'src/n' || c_nationkey || '.ts', 'import { load as l } from "./n' || c_nationkey || '";' || chr(10) || 'export function run() { l(); own(); }' || chr(10) || 'function own() {}' || chr(10) from customer
union all select 'svc/n' || n_nationkey || '.py', null, 'def load():' || chr(10) || '    pass' || chr(10) from nation
union all select 'src/n' || n_nationkey || '.ts', null, 'export function load() {}' || chr(10) from nation)"""
_LINKS_SQL = """links as (select 'file:' || path as src, 'def:' || uses || '#load@1' as dst, kind from code, (values ('import'), ('call')) k(kind) where uses is not null
union all select 'file:' || path, 'def:' || path || '#own@3', 'call' from code where ends_with(path, '.ts') and uses is not null)"""
_DEFS_SQL = """defs as (select path, 'FUNCTION' as kind, case when uses is null then 'load' else 'run' end as qualified, case when uses is null then 1 when ends_with(path, '.py') then 4 else 2 end as line from code
union all select path, 'FUNCTION', 'own', 3 from code where ends_with(path, '.ts') and uses is not null)"""
_SYMBOL_STEPS = 8


def code(spark, sf_dir):
    """``path, content`` of suppliers, customers and nations as source files."""
    key = lambda c: F.col(c).cast("string")
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("svc/s"), key("s_suppkey"), F.lit(".py")).alias("path"), F.concat(F.lit("from .n"), key("s_nationkey"), F.lit(" import load\n\n\ndef run():\n    load()\n")).alias("content"))
    text = F.concat(F.lit('import { load as l } from "./n'), key("c_nationkey"), F.lit('";\nexport function run() { l(); own(); }\nfunction own() {}\n'))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("src/c"), key("c_custkey"), F.lit(".ts")).alias("path"), text.alias("content"))
    nation = table(spark, sf_dir, "nation")
    modules = [nation.select(F.concat(F.lit(f"{folder}/n"), key("n_nationkey"), F.lit(end)).alias("path"), F.lit(body).alias("content")) for folder, end, body in (("svc", ".py", "def load():\n    pass\n"), ("src", ".ts", "export function load() {}\n"))]
    return supplier.union(customer).union(modules[0]).union(modules[1])


def _links(spark, sf_dir):
    from ..operators import symbols

    return symbols.links(symbols.spread(code(spark, sf_dir)))


def _graph(spark, sf_dir):
    from ..operators import symbols

    sources = code(spark, sf_dir)
    return *symbols.parsed(symbols.spread(sources)), sources, _no_aliases(spark)


def _no_aliases(spark):
    return spark.createDataFrame([], "ord int, pattern string, target string")


@query(f"with {_CODE_SQL} select path, case when ends_with(path, '.py') then '.' || regexp_extract(uses, '(n[0-9]+)', 1) else './' || regexp_extract(uses, '(n[0-9]+)', 1) end as module, uses as target from code where uses is not null")
def module_resolution(spark, sf_dir):
    return graph.resolved_modules(kept(_links(spark, sf_dir).where("kind = 'import'"), "imports"), code(spark, sf_dir), _no_aliases(spark))


_STEM = "regexp_extract(path, '([^/]*)\\.[a-z]+$', 1)"


@query(
    f"""with f as (select source as repo, path, {_STEM} as stem, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '\\.[a-z]+$') in ('.ts', '.py', '.go') as known from {FILES_SQL} f0 where source is not null),
m as (select repo, min(path) as first from f group by repo)
select repo, path, '@' || repo || '/' || stem as module, path as target from f where known union all select repo, path, 'gen/' || stem || '.x', path from f where known union all select f.repo, path, 'main', first from f join m using (repo)"""
)
def module_aliases(spark, sf_dir):
    """Each repository has an exact alias, and two with a star, one of them with an end; each file imports by all three, and by one of nobody."""
    code = files(spark, sf_dir).where("source is not null").select(F.col("source").alias("repo"), "path")
    folder, stem = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)\.[a-z]+$", 1)
    names = F.array(F.concat(F.lit("@"), "repo", F.lit("/"), stem), F.concat(F.lit("gen/"), stem, F.lit(".x")), F.lit("main"), F.concat(F.lit("@nobody/"), stem))
    each = code.groupBy("repo").agg(F.min("path").alias("first"), F.min(folder).alias("dir"))
    rule = lambda ord, pattern, target: F.struct(F.lit(ord).alias("ord"), pattern.alias("pattern"), target.alias("target"))
    inside = F.concat("dir", F.lit("/*"))
    rules = each.select("repo", F.explode(F.array(rule(0, F.concat(F.lit("@"), "repo", F.lit("/*")), inside), rule(1, F.lit("gen/*.x"), inside), rule(2, F.lit("main"), F.col("first"))))).select("repo", "col.*")
    return graph.resolved_modules(code.withColumn("module", F.explode(names)), code, rules)


@query(
    """with r as (select source as repo, min(lang) as lang, count(*) as n from documents where source is not null group by source)
select repo, 0 as ord, '@' || repo || '/*' as pattern, 'web/src/lib/*' as target from r union all select repo, 1, '@' || repo || '/*', 'web/./' || lang || '/*' from r
union all select repo, 2, 'a//b', 'web/src/n' || n || '/*, ]' from r"""
)
def config_aliases(spark, sf_dir):
    """Aliases of a configuration of each repository, with comments, trailing commas and values that do not belong."""
    repos = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("repo")).agg(F.min("lang").alias("lang"), F.count("*").cast("string").alias("n"))
    text = F.concat(
        F.lit('{ // of "'), "repo", F.lit('"\n "compilerOptions": {"baseUrl": "src", /* "x": [ */ "paths": {"@'), "repo", F.lit('/*": ["lib/*", "./'), "lang", F.lit('/*", 7, ],"bad": 1, "a//b": ["n'), "n", F.lit('/*, ]"],}, }}')
    )
    return repositories.configured_aliases(repos.select("repo", F.lit("web").alias("folder"), text.alias("content")))


@query(f"with {_CODE_SQL}, {_LINKS_SQL} select src, dst, kind from links")
def symbol_edges(spark, sf_dir):
    return graph.symbol_edges(*_graph(spark, sf_dir))


def _symbol_rank_sql():
    node = "node as (select 'file:' || path as id from code union all select 'def:' || path || '#' || qualified || '@' || line from defs)"
    steps = [_CODE_SQL, _LINKS_SQL, _DEFS_SQL, node, "edge as (select src, dst from links)", "deg as (select src, count(*)::double as d from edge group by src)", "n as (select count(*)::double as n from node)", "r0 as (select id, 1.0 / n as rank from node, n)"]
    for i in range(1, _SYMBOL_STEPS + 1):
        p = f"r{i - 1}"
        steps.append(
            f"g{i} as (select dst as id, sum(rank / d) as got from edge join {p} on {p}.id = src join deg using (src) group by dst), x{i} as (select coalesce(sum(rank), 0) as dang from {p} where id not in (select src from edge)), "
            f"r{i} as (select {p}.id, 0.15 / n + 0.85 * dang / n + 0.85 * coalesce(got, 0) as rank from {p} left join g{i} using (id), x{i}, n)"
        )
    last = f"select path, qualified, kind, line, rank * 1000 as rank from defs join r{_SYMBOL_STEPS} on id = 'def:' || path || '#' || qualified || '@' || line"
    return f"with {', '.join(steps)}, o as ({last}) select path, qualified, kind, line, round(rank, 6) as rank, row_number() over (order by round(rank, 6) desc, path, line) as place from o"


@query(_symbol_rank_sql())
def ranked_symbols(spark, sf_dir):
    defs, refs, sources, aliases = _graph(spark, sf_dir)
    ranks = graph.page_rank(graph.symbol_nodes(defs, sources), graph.symbol_edges(defs, refs, sources, aliases), iterations=_SYMBOL_STEPS, tolerance=0.0)
    ranks = ranks.withColumn("rank", F.round(F.col("rank") * 1000, 6))
    return graph.ranked_symbols(defs, ranks).select("path", "qualified", "kind", "line", "rank", "place")


@query(
    f"""with {_CODE_SQL}, l as (select path, uses, string_split(content, chr(10)) as l, ends_with(path, '.py') as py from code),
part as (select path, 0 as chunk_no, 'FILE: ' || path as header, l[1] as body from l where uses is not null
union all select path, 1, 'FILE: ' || path || ' | FUNCTION: run', case when py then l[4] || chr(10) || l[5] else l[2] end from l where uses is not null
union all select path, 2, 'FILE: ' || path || ' | FUNCTION: own', l[3] from l where uses is not null and not py
union all select path, 0, 'FILE: ' || path || ' | FUNCTION: load', case when py then l[1] || chr(10) || l[2] else l[1] end from l where uses is null)
select path as source_path, chunk_no, header || chr(10) || chr(10) || body as text from part"""
)
def symbol_chunks(spark, sf_dir):
    from ..operators import symbols

    return symbols.symbol_chunks(code(spark, sf_dir))


@query(
    f"""with {_CODE_SQL} select path, 'CONTEXT | imports: ' || case when ends_with(path, '.py') then 'load' else 'load, ' || regexp_extract(uses, '(n[0-9]+)', 1) || ' | exports: run' end as context from code where uses is not null
union all select path, 'CONTEXT | exports: load' from code where uses is null and ends_with(path, '.ts')"""
)
def file_contexts(spark, sf_dir):
    return chunking.file_contexts(_links(spark, sf_dir))


# the passages that a query should find: the document of its own number and the one after
_LEG_GOLD = f"gold as (select item_id as query_id, case when item_id % 2 = 0 then 'even' else 'odd' end as kind, path from benchmark join {FILES_SQL} f on f.doc_id in (item_id, item_id + 1))"


@query(
    "with " + ", ".join([_BM25.format(passages=PASSAGES_SQL, k=30), _VEC.format(k=30), _RRF, _LEG_GOLD])
    + f""", al2 as (select 'fused' as leg, query_id, id, rank from fu where rank <= 10 union all select 'vector', query_id, id, rank from vec where rank <= 10 union all select 'lexical', query_id, id, rank from lex where rank <= 10),
hit as (select leg, query_id, rank, path from al2 join {FILES_SQL} f on f.doc_id = id), g as (select query_id, kind, count(*) as n from gold group by all), l as (select distinct leg from al2),
m as (select leg, query_id, count(distinct case when rank <= 1 then path end) as h1, count(distinct case when rank <= 5 then path end) as h5, min(rank) as r from hit join gold using (query_id, path) group by all)
select leg, query_id, kind, round(coalesce(h1, 0) / n, 6) as recall_1, round(coalesce(h5, 0) / n, 6) as recall_5, round(coalesce(1.0 / r, 0), 6) as rr from g cross join l left join m using (leg, query_id)"""
)
def leg_metrics(spark, sf_dir):
    source = passages(spark, sf_dir)
    vector, lexical = _legs(spark, sf_dir, 10, source)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.col("item_id"), F.col("item_id") + 1)).alias("doc_id"))
    gold = items.join(files(spark, sf_dir), "doc_id").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"), "path")
    out = evaluate.leg_metrics(vector, lexical, source, gold)
    return out.select("leg", "query_id", "kind", *[F.round(c, 6).alias(c) for c in _METRICS])


# --- streams in batch form -----------------------------------------------------------------------------


@query(
    """with e as (select user_id, ts, event_id, event_type, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 1 hour then 0 else 1 end as n from events),
g as (select *, sum(n) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as k from e)
select user_id::varchar as repo, min(ts) as start, max(ts) + interval 1 hour as "end", string_agg(distinct event_type, ',' order by event_type) as paths, count(*) as n from g group by user_id, k"""
)
def debounce_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), "ts", F.col("event_type").alias("path"))
    out = watch.debounced(events, "1 hour")
    return out.select("repo", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), F.array_join("paths", ",").alias("paths"), "n")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark, sf_dir):
    out = watch.windowed_counts(table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

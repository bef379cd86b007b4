"""Batched hybrid search: exact vector top-k, BM25, reciprocal rank fusion, budgets and demotion.

Queries come in batches. A batch of at most ``QUERY_ROWS`` queries goes to the tasks as one block; more are taken
block by block, each reading the index once. A task scores its rows against the block with array operations and
keeps the best k of each query, so what is shuffled is k rows for each query and task, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.paths import test_path
from ..functions.text import budget_path, index_terms, query_terms, truncated
from ..storage import kept

RRF_K, RRF_WEIGHTS, PLAIN_K = 10, {"vector": 2.0, "lexical": 1.0}, 60
K1, B = 1.2, 0.75
QUERY_ROWS, CELLS, SLACK = 2048, 1 << 21, 1e-9


def candidates(limit: int) -> int:
    """How many hits each leg gives for so many results."""
    return max(3 * limit, 15)


def postings(passages: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """``id, dl, terms``: the index of passages, each with its terms in order and their number.

    Keep it as a table: searches read it two or three times and tokenise nothing.
    """
    return passages.select(id, index_terms(text).alias("terms")).select(id, F.size("terms").alias("dl"), "terms")


class _Best:
    """The best k hits of each query among those of one task, with all that come within rounding of the k-th."""

    def __init__(self, k: int):
        self.k, self.held, self.parts = k, 0, []

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.parts.append((query, score, ids))
        self.held += len(query)
        if self.held > 1 << 18:
            self.merge()
            self.held = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, query)
        last = np.minimum(first + self.k, np.searchsorted(query, query, "right")) - 1
        good = score >= score[last] - SLACK
        self.parts = [(query[good], score[good], ids.take(pa.array(order[good])))]
        return self.parts[0]


def blocks(queries: DataFrame, order: str, *columns: str) -> Iterator[pa.Table]:
    """The queries, at most ``QUERY_ROWS`` at a time; however often an ``order`` repeats."""
    some = queries.select(*columns).limit(QUERY_ROWS + 1).toArrow()
    if some.num_rows <= QUERY_ROWS:
        yield some
        return
    # rows are numbered within hash buckets, so that no window holds all of them, and written once, so that their numbers stay
    parts = -(-queries.count() // QUERY_ROWS)
    salted = queries.select(*columns, F.pmod(F.xxhash64(order, F.monotonically_increasing_id()), F.lit(2 * parts)).alias("__part"))
    numbered = kept(salted.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(order))), "queries")
    sizes = {r["__part"]: r.n for r in numbered.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    for part in sorted(sizes):
        for a in range(0, sizes[part], QUERY_ROWS):
            yield numbered.where((F.col("__part") == part) & (F.col("__row") > a) & (F.col("__row") <= a + QUERY_ROWS)).select(*columns).toArrow()


def task_hits(rows: DataFrame, id: str, queries: DataFrame, k: int, names: pa.Array, score_rows) -> DataFrame:
    """``query_id, id, score``: each task's best of ``score_rows``, which gives (query, row, score) arrays of a batch."""

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for query, row, score in score_rows(batch):
                best.add(query, score, batch.column(id).take(pa.array(row)))
        if (found := best.merge()) is not None:
            query, score, ids = found
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids, pa.array(score)], names=["query_id", id, "score"])

    schema = StructType([queries.schema["query_id"], rows.schema[id], StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def no_hits(id: StructField, spark: SparkSession, queries: DataFrame) -> DataFrame:
    return spark.createDataFrame([], StructType([queries.schema["query_id"], id, StructField("score", DoubleType())]))


def largest(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each column's k largest values, and of what comes within rounding of them."""
    if len(score) > k:
        least = np.partition(score, len(score) - k, axis=0)[len(score) - k]
        return np.nonzero(score >= least - SLACK)
    return np.nonzero(np.ones(score.shape, bool))


def _scoped(rows: DataFrame, scope: DataFrame | Column | None, id: str) -> DataFrame:
    """The rows that meet a condition, or whose ids a table holds."""
    if scope is None:
        return rows
    return rows.where(scope) if isinstance(scope, Column) else rows.join(scope.select(id).distinct(), id, "left_semi")


def bm25(index: DataFrame, queries: DataFrame, k: int, id: str = "id", scope: DataFrame | Column | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the k best passages of each query by BM25 over OR'ed terms.

    A term that a query repeats counts as often; null texts have no terms. Corpus statistics cover all of ``index`` (as of
    ``postings``); ``scope`` (ids, or a condition on the index) only filters what is returned. No queries, or none with a known term: no rows.
    """
    rows = _scoped(index, scope, id)
    terms = queries.select("query_id", F.explode(query_terms(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    asked, found = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "n")).alias("terms")), None
    for block in blocks(asked, "query_id", "query_id", "terms"):
        if block.num_rows and k > 0:
            hits = task_hits(rows.select(id, "dl", "terms"), id, queries, k, block["query_id"].combine_chunks(), _bm25_rows(block, index, k))
            found = hits if found is None else found.unionByName(hits)
    found = no_hits(rows.schema[id], rows.sparkSession, queries) if found is None else found
    return top_k(found, k, F.round(F.col("score"), 9).desc(), F.col(id))


def _term_counts(index: DataFrame, words: pa.Array) -> tuple[int, int, np.ndarray]:
    """Number of passages, their terms in all, and how many passages have each of some words: three sums a task, and one for each word."""

    def run(batches):
        n, length, df = 0, 0, np.zeros(len(words), np.int64)
        for batch in batches:
            terms = batch.column("terms")
            size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
            word = pc.index_in(terms.flatten(), words)
            doc = np.repeat(np.arange(batch.num_rows), size)[np.asarray(word.is_valid())]
            pair = np.unique(doc * max(1, len(words)) + word.drop_null().to_numpy())
            n, length, df = n + batch.num_rows, length + int(size.sum()), df + np.bincount(pair % max(1, len(words)), minlength=len(words))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n, length], df[some]]))], names=["word", "n"])

    sums = index.select("terms").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, count = sums["word"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(len(words), np.int64)
    df[word[word >= 0]] = count[word >= 0]
    return int(count[word == -1].sum()), int(count[word == -2].sum()), df


class Weights:
    """What the terms of a block of queries weigh in a corpus.

    Each term of a passage meets the queries that ask for it; terms that many queries ask for are a matrix product instead.
    """

    @staticmethod
    def words(block: pa.Table) -> pa.Array:
        """The distinct terms of ``query_id, terms``."""
        return pc.unique(block["terms"].combine_chunks().flatten().field("term"))

    def __init__(self, block: pa.Table, words: pa.Array, n: int, length: int, df: np.ndarray):
        lists = block["terms"].combine_chunks()
        flat, query = lists.flatten(), np.repeat(np.arange(block.num_rows), np.diff(np.asarray(lists.offsets)))
        self.queries, self.avgdl = block.num_rows, length / n if length else 1.0
        idf = np.log((n - df + 0.5) / (df + 0.5))
        of = pc.index_in(flat.field("term"), words).to_numpy()
        weight = flat.field("n").to_numpy() * np.where(idf > 0, idf, 1e-6)[of]
        asked = np.bincount(of, minlength=len(words))
        self.hot = hot = asked > max(8, block.num_rows // 8)
        self.place = np.cumsum(hot) - 1
        self.dense = np.zeros((int(hot.sum()), block.num_rows))
        self.dense[self.place[of[hot[of]]], query[hot[of]]] = weight[hot[of]]
        order = np.flatnonzero(~hot[of])[np.argsort(of[~hot[of]], kind="stable")]
        self.query, self.weight = query[order], weight[order]
        self.count = np.where(hot, 0, asked)
        self.first = np.cumsum(self.count) - self.count

    def part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """What a term of so many occurrences in a passage of such a length counts, before its weight."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))

    def steps(self, doc: np.ndarray, word: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
        """First and last place (exclusive) of some passages at a time: bounded scores, and bounded meetings of terms and queries."""
        work = np.cumsum(np.bincount(doc, self.count[word], rows)) // CELLS + np.arange(rows) // max(1, CELLS // self.queries)
        edges = [0, *(np.flatnonzero(np.diff(work)) + 1).tolist(), rows]
        return zip(edges[:-1], edges[1:], strict=True)

    def scores(self, doc: np.ndarray, word: np.ndarray, part: np.ndarray, rows: int) -> np.ndarray:
        """Scores of ``rows`` passages by queries, from their distinct terms."""
        here = self.hot[word]
        tf = np.zeros((rows, len(self.dense)))
        tf[doc[here], self.place[word[here]]] = part[here]
        n = self.count[word]
        at = np.repeat(self.first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(doc, n) * self.queries + self.query[at]
        return tf @ self.dense + np.bincount(cell, np.repeat(part, n) * self.weight[at], rows * self.queries).reshape(rows, self.queries)


def _bm25_rows(block: pa.Table, index: DataFrame, k: int):
    """Scores passages against a block of queries, by the statistics of the whole index."""
    words = Weights.words(block)
    weights = Weights(block, words, *_term_counts(index, words))

    def rows(batch):
        terms = batch.column("terms")
        size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
        word = pc.index_in(terms.flatten(), words)
        doc = np.repeat(np.arange(batch.num_rows), size)[np.asarray(word.is_valid())]
        pair, tf = np.unique(doc * len(words) + word.drop_null().to_numpy(), return_counts=True)
        doc, word = np.divmod(pair, len(words))
        part = weights.part(tf, size[doc])
        for a, b in weights.steps(doc, word, batch.num_rows):
            lo, hi = np.searchsorted(doc, (a, b))
            score = weights.scores(doc[lo:hi] - a, word[lo:hi], part[lo:hi], b - a)
            row, query = largest(score, k)
            some = score[row, query] > 0
            yield query[some], a + row[some], score[row, query][some]

    return rows


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, id: str = "id", scope: DataFrame | Column | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the k vectors of greatest cosine for each of ``query_id, vector``, exactly.

    A null, zero or non-finite vector has cosine 0 with all; vectors of another length than a query's are not compared with it.
    """
    base = _scoped(vectors, scope, id)
    found = None
    for block in blocks(queries, "query_id", "query_id", "vector"):
        lists = block["vector"].combine_chunks()
        for n in pc.unique(pc.fill_null(pc.list_value_length(lists), 0)).to_pylist():
            own = pc.equal(pc.fill_null(pc.list_value_length(lists), 0), n)
            hits = task_hits(base.select(id, "embedding"), id, queries, k, block["query_id"].combine_chunks().filter(own), _cosine_rows(unit(lists.filter(own), n), k)) if k > 0 else no_hits(base.schema[id], base.sparkSession, queries)
            found = hits if found is None else found.unionByName(hits)
    found = no_hits(base.schema[id], base.sparkSession, queries) if found is None else found
    return top_k(found, k, F.round(F.col("score"), 9).desc(), F.col(id))


def unit(lists: pa.Array, n: int) -> np.ndarray:
    """Rows of length 1 in double precision; null, zero and non-finite ones become zero."""
    out = np.zeros((len(lists), n))
    given = np.asarray(lists.is_valid())
    if n and given.any():
        out[given] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        out[~np.isfinite(out).all(1)] = 0
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    return out


def _cosine_rows(asked: np.ndarray, k: int):
    """Scores vectors against a block of queries: one matrix product for some rows at a time."""
    n = asked.shape[1]
    step = max(1, CELLS // max(1, len(asked)))

    def rows(batch):
        for a in range(0, batch.num_rows, step):
            lists = batch.column("embedding").slice(a, step)
            size = pc.fill_null(pc.list_value_length(lists), n)
            at = np.flatnonzero(np.asarray(pc.equal(size, n)))
            if len(at):
                score = unit(lists.take(pa.array(at)), n) @ asked.T
                row, query = largest(score, k)
                yield query, a + at[row], score[row, query]

    return rows


def rrf(legs: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = RRF_WEIGHTS, id: str = "id") -> DataFrame:
    """``query_id, id, score, rank``: sum of weight / (k + rank) over the legs; ties go to the first seen, by leg and rank."""
    if weights is not None and set(weights) != set(legs):
        raise ValueError("one weight for each leg is needed")
    all_hits = None
    for number, (name, hits) in enumerate(legs.items()):
        one = hits.select("query_id", id, ((weights or {}).get(name, 1.0) / (F.lit(float(k)) + F.col("rank"))).alias("part"), (F.lit(number * (1 << 32)) + F.col("rank")).alias("seen"))
        all_hits = one if all_hits is None else all_hits.unionByName(one)
    scored = all_hits.groupBy("query_id", id).agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    return top_k(scored, 1 << 30, F.round(F.col("score"), 12).desc(), F.col("seen")).drop("seen")


def hybrid(vector: DataFrame, lexical: DataFrame, limit: int, id: str = "id") -> DataFrame:
    """Both legs fused, the first ``limit``; a query without vector hits has no results."""
    fused = rrf({"vector": vector, "lexical": lexical.join(vector.select("query_id").distinct(), "query_id", "left_semi")}, id=id)
    return fused.where(F.col("rank") <= limit)


def legs(vector: DataFrame, lexical: DataFrame, limit: int, id: str = "id") -> DataFrame:
    """``leg, query_id, id, score, rank`` of the vector, lexical and fused leg; single legs are scored with k = 60."""
    alone = {n: rrf({n: h}, PLAIN_K, None, id).where(F.col("rank") <= limit) for n, h in (("vector", vector), ("lexical", lexical))}
    parts = [df.select(F.lit(n).alias("leg"), "query_id", id, "score", "rank") for n, df in {**alone, "fused": hybrid(vector, lexical, limit, id)}.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def budgeted(results: DataFrame, limit: int, max_per_file: int = 2, max_chars: int = 1200, id: str = "id") -> DataFrame:
    """At most ``max_per_file`` results of one file and ``limit`` in all, by rank; texts cut to ``max_chars``."""
    path = budget_path("text")
    key = F.coalesce(path, F.concat(F.lit("passage:"), F.col(id).cast("string")))
    of_file = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    kept = results.withColumn("file_path", path).withColumn("__n", of_file).where(F.col("__n") <= max_per_file)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = kept.withColumn("place", place).where(F.col("place") <= limit).drop("__n")
    return kept.withColumn("truncated", F.length("text") > max_chars).withColumn("text", truncated("text", max_chars))


def demoted(results: DataFrame, place: str = "place") -> DataFrame:
    """Results of test files after all others, otherwise in order."""
    test = F.coalesce(test_path(budget_path("text")), F.lit(False))
    return results.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(test, place)))


def tool_search(vector: DataFrame, lexical: DataFrame, passages: DataFrame, top: int = 5, id: str = "id") -> DataFrame:
    """The search of the assistant's tool: 1 to 10 results, twice as many fetched, budgeted, tests last."""
    top = min(10, max(1, top))
    fused = hybrid(vector, lexical, min(20, 2 * top), id).join(passages.select(id, "text"), id)
    return demoted(budgeted(fused, top, id=id))

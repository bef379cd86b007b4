"""Exact nearest vectors by cosine, from cells around pivots, of which a search reads those that can hold a hit.

Every vector belongs to the pivot with the least angle to it, and a cell notes the least and the greatest angle of its vectors
to its pivot. Angles between unit vectors obey the triangle inequality: from the angle of a query to a pivot follows the
least angle that it can have to any vector of the cell. A search scores each query's nearest cells, takes the k-th cosine found
there as its threshold, and then reads the cells whose bound reaches it, for the queries for which it does. No hit is lost; how much
is skipped depends on how the vectors cluster.

Pivots are a bounded sample of the vectors, by a hash of their ids; the sample changes what is skipped, not what is found. Null, zero and
non-finite vectors have cosine 0 with all and a cell of their own (-1); vectors of other lengths than the pivots' (-2) are compared with queries of theirs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .search import CELLS, SLACK, _scoped, blocks, largest, no_hits, task_hits, top_k, unit, vector_top_k

PIVOTS, FAN_ROWS = 256, 1 << 20
FLAT, OTHER = -1, -2


@dataclass
class Read:
    """Pairs of queries and vectors in all, and how many of them a search compared."""

    pairs: int = 0
    compared: int = 0


class PivotIndex:
    """An index under a folder that Spark can read; made by ``write``."""

    def __init__(self, spark: SparkSession, path: str, id: str = "id"):
        self.spark, self.path, self.id = spark, path.rstrip("/"), id
        layout = spark.read.parquet(f"{self.path}/layout").first()
        self.rows = spark.read.schema(StructType.fromJson(json.loads(layout.schema))).parquet(f"{self.path}/cells")
        self.pivots = np.array(layout.pivots, np.float64).reshape(-1, layout.size) if layout.size else np.zeros((0, 0))
        # one row for each cell: at most as many as pivots
        table = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        self.n = {r.cell: r.n for r in table}
        self.low, self.high = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        for r in table:
            if r.cell >= 0:
                self.low[r.cell], self.high[r.cell] = r.low, r.high
        self.read = Read()

    @staticmethod
    def write(vectors: DataFrame, path: str, id: str = "id", embedding: str = "embedding", pivots: int = PIVOTS) -> PivotIndex:
        """Index ``id, embedding``; the layout file comes last: without it there is no index."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = vectors.select(F.col(id), F.col(embedding).cast("array<double>").alias("embedding"))
        finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        sample = rows.where(finite & F.exists("embedding", lambda x: x != 0))
        # the most frequent length, and the first so many of it by a hash
        length = sample.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
        size = length.n if length else 0
        chosen = sample.where(F.size("embedding") == size).orderBy(F.xxhash64(id), id).select("embedding").limit(pivots).toArrow()["embedding"] if size else None
        centres = np.unique(unit(chosen.combine_chunks(), size), axis=0) if size else np.zeros((0, 0))

        def assign(batches):
            for batch in batches:
                lists = batch.column("embedding")
                cell, angle = np.full(batch.num_rows, FLAT, np.int32), np.zeros(batch.num_rows)
                lengths = pc.fill_null(pc.list_value_length(lists), size).to_numpy(zero_copy_only=False)
                cell[lengths != size] = OTHER
                step = max(1, CELLS // max(1, len(centres)))
                for a in range(0, batch.num_rows, step):
                    at = a + np.flatnonzero(lengths[a : a + step] == size)
                    if not len(at) or not size:
                        continue
                    points = unit(lists.take(pa.array(at)), size)
                    cosine = points @ centres.T
                    near, flat = cosine.argmax(1), ~points.any(1)
                    cell[at] = np.where(flat, FLAT, near)
                    angle[at] = np.where(flat, 0, np.arccos(np.clip(cosine[np.arange(len(at)), near], -1, 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

        schema = StructType(rows.schema.fields[:]).add("cell", IntegerType()).add("angle", DoubleType())
        fan = 1 + rows.count() // (max(1, len(centres)) * FAN_ROWS)  # files of a cell
        laid = rows.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64(id), F.lit(fan))).sortWithinPartitions("cell")
        laid.write.partitionBy("cell").parquet(f"{path}/cells")
        spark.createDataFrame([(size, centres.reshape(-1).tolist(), laid.schema.json())], "size int, pivots array<double>, schema string").coalesce(1).write.parquet(f"{path}/layout")
        return PivotIndex(spark, path, id)

    def top_k(self, queries: DataFrame, k: int, scope: DataFrame | Column | None = None) -> DataFrame:
        """``query_id, id, score, rank``: the hits of ``search.vector_top_k``, from the cells that can hold them."""
        found, size = None, self.pivots.shape[1]
        other = queries.where(F.coalesce(F.size("vector"), F.lit(0)) != size)
        if k > 0 and other.limit(1).count():
            found = vector_top_k(self.rows.where(F.col("cell").isin(FLAT, OTHER)), other, k, self.id, scope).drop("rank")
        for block in blocks(queries.where(F.size("vector") == size), "query_id", "query_id", "vector"):
            if block.num_rows and k > 0:
                hits = self._hits(block, k, queries, scope)
                found = hits if found is None else found.unionByName(hits)
        found = no_hits(self.rows.schema[self.id], self.spark, queries) if found is None else found
        return top_k(found, k, F.round(F.col("score"), 9).desc(), F.col(self.id))

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """For each query and cell the greatest cosine that a vector of the cell can have; the last column is that of the cell -1."""
        angle = np.arccos(np.clip(asked @ self.pivots.T, -1, 1))
        least = np.maximum(0, np.maximum(angle - self.high, self.low - angle))
        bound = np.where(np.isfinite(least), np.cos(np.minimum(least, np.pi)), -np.inf) + SLACK
        bound[~asked.any(1)] = np.where(np.isfinite(self.low), SLACK, -np.inf)  # a zero query has cosine 0 with all
        return np.column_stack([bound, np.full(len(asked), SLACK if FLAT in self.n else -np.inf)])

    def _hits(self, block: pa.Table, k: int, queries: DataFrame, scope) -> DataFrame:
        asked = unit(block["vector"].combine_chunks(), self.pivots.shape[1])
        bound = self.bounds(asked)
        n = np.array([self.n.get(c, 0) for c in [*range(len(self.pivots)), FLAT]])
        # the nearest cells of each query that hold k vectors together
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= np.isfinite(bound)
        best = top_k(self._scored(first, asked, block, k, queries, scope), k, F.col("score").desc())
        least, at = np.full(len(asked), -np.inf), {}
        for i, q in enumerate(block["query_id"].to_pylist()):
            at.setdefault(q, []).append(i)
        for r in best.where(F.col("rank") == k).select("query_id", "score").collect():  # a number for each query of the block
            if len(at[r.query_id]) == 1:  # of a repeated id nothing is skipped
                least[at[r.query_id][0]] = r.score - SLACK
        on = np.isfinite(bound) & (bound >= least[:, None])
        self.read = Read(self.read.pairs + int(n.sum()) * len(asked), self.read.compared + int((on * n).sum()))
        return self._scored(on, asked, block, k, queries, scope)

    def _scored(self, on: np.ndarray, asked: np.ndarray, block: pa.Table, k: int, queries: DataFrame, scope) -> DataFrame:
        """``query_id, id, score`` of the pairs of queries and cells that ``on`` names; other cells' folders are not read."""
        cells = [int(c) if c < len(self.pivots) else FLAT for c in np.flatnonzero(on.any(0))]
        rows = _scoped(self.rows.where(F.col("cell").isin(cells)), scope, self.id)
        size = asked.shape[1]

        def score(batch):
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell):
                query = np.flatnonzero(on[:, c])
                step = max(1, CELLS // max(1, len(query)))
                own = np.flatnonzero(cell == c)
                for a in range(0, len(own), step):
                    at = own[a : a + step]
                    lists = batch.column("embedding").take(pa.array(at))
                    points = np.zeros((len(at), size)) if c == FLAT else unit(lists, size)
                    value = points @ asked[query].T
                    row, of = largest(value, k)
                    yield query[of], at[row], value[row, of]

        return task_hits(rows.select(self.id, "embedding", "cell"), self.id, queries, k, block["query_id"].combine_chunks(), score)

"""An inverted index with block maxima: postings by term, cut at segments of passages, and searches that skip blocks.

A segment is up to ``SEGMENT`` passages of one task, of ``SEGMENT_SIZE`` together. A block is one term's passages in one segment: places within
the segment with term frequencies, and the front of those: the pairs of frequency and length that no other pair beats in both. A row of
the index holds the blocks of one segment whose terms fall into one of ``buckets`` by their hash. Rows lie in folders by bucket, so that a search reads
the folders of the terms that it is asked for; what a segment adds to a folder is bounded, however common its terms.
One more row for each segment (bucket -1) holds its passages' ids and lengths.

Spark reads up to 4,096 rows of a row group at once, and for each number of a list two more for its levels. So numbers are packed, row groups hold
``ROW_GROUP`` bytes, and a file up to ``FAN`` segments: what a task reads and sorts is bounded, whatever the size of the index.

The front gives the most that a block adds to a score exactly, whatever the corpus' average length has become.
A search adds these bounds over its terms for each segment and query, scores the segments with the best bounds, takes the k-th score of
each query found there as its threshold, and then scores the other segments only for queries whose bound reaches it: no hit is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.terms import terms
from ..functions.text import query_terms
from ..storage import kept
from .search import B, K1, SLACK, Weights, blocks, largest, no_hits, top_k

SEGMENT, BUCKETS, SEEDS, LEAST_SEGMENTS, FAN = 1024, 64, 2, 64, 1024
SEGMENT_SIZE = 1 << 22  # bytes of text of a segment, or of one longer passage; terms count as 8 bytes
ROW_GROUP = 1 << 23  # bytes
PORTION = 1 << 19  # bytes of postings (or values, where they are lists) that a search takes from a batch of index rows at a time


def bucket_of(terms: list[str], buckets: int) -> np.ndarray:
    """The folder of each term."""
    return np.fromiter((crc32(t.encode()) for t in terms), np.int64, len(terms)) % buckets


def blocks_of(passages: DataFrame, id: str = "id", text: str = "text", group: str | None = None, buckets: int = BUCKETS, segment: int = SEGMENT) -> DataFrame:
    """The index rows of passages, from their ``text`` or, where they have it, their list of ``terms``; segments never mix values of ``group``.

    Every row is made where its passages are read; nothing is shuffled.
    """
    known = "terms" in passages.columns
    schema = StructType([StructField("bucket", IntegerType()), StructField("seg", LongType()), StructField("grp", StringType()), StructField("terms", ArrayType(StringType())), StructField("ns", ArrayType(IntegerType()))] + [StructField(n, BinaryType()) for n in ("fronts", "front_tf", "front_dl", "docs", "tfs")] + [StructField("dls", ArrayType(IntegerType())), StructField("ids", ArrayType(passages.schema[id].dataType))])
    rows = passages.select(F.monotonically_increasing_id().alias("at"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), F.col(id).alias("id"), F.col("terms" if known else text).alias("said"))

    def run(batches):
        for batch in batches:
            at, grp = batch.column("at"), batch.column("grp")
            code = grp.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            length = pc.list_value_length if known else pc.binary_length
            size = pc.fill_null(length(batch.column("said")), 0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if known else 1)
            for value in np.unique(code):
                own = np.flatnonzero(code == value)
                for a, b in cuts(size[own], segment):
                    some = pa.array(own[a:b])
                    said, first = batch.column("said").take(some), int(own[a])
                    found, sizes = (said.flatten(), pc.fill_null(pc.list_value_length(said), 0).to_numpy(zero_copy_only=False)) if known else terms(said)
                    yield _segment(at[first].as_py(), grp[first].as_py(), batch.column("id").take(some), found, sizes.astype(np.int32), buckets)

    return rows.mapInArrow(run, schema)


def cuts(size: np.ndarray, rows: int, most: int = SEGMENT_SIZE) -> Iterator[tuple[int, int]]:
    """First and last place (exclusive) of runs of at most so many passages and so many bytes together, or of one that is longer."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))))
        yield a, b
        a = b


def packed(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Runs of so many values each, as bytes: the least of 1, 2 or 4 for a value that holds all."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    ends = (np.concatenate([[0], np.cumsum(count)]) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(values.astype(f"<u{width}"))])


def unpacked(runs: pa.Array, count: np.ndarray) -> np.ndarray:
    """The values of ``packed``, one run after the other; runs of an index that was written as lists are taken as they are."""
    if pa.types.is_list(runs.type):
        return runs.flatten().to_numpy()
    out, start = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
    width = pc.binary_length(runs).to_numpy(zero_copy_only=False) // np.maximum(count, 1)
    for w in np.unique(width[count > 0]):
        own = np.flatnonzero((width == w) & (count > 0))
        some = runs.take(pa.array(own)).cast(pa.binary())
        ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        out[ranges(start[own], count[own])] = np.frombuffer(some.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(f"<u{w}")
    return out


def _lists(values: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """Values, in order of the row that they belong to, as lists."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))


def _segment(seg: int, grp: str | None, ids: pa.Array, found: pa.Array, dls: np.ndarray, buckets: int) -> pa.RecordBatch:
    coded = found.dictionary_encode()
    names = coded.dictionary
    bucket = bucket_of(names.to_pylist(), buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # blocks in order of bucket and term, passages in each
    pair, tf = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * len(ids) + np.repeat(np.arange(len(ids)), dls), return_counts=True)
    term, doc = np.divmod(pair, len(ids))
    n = np.bincount(term, minlength=len(names))
    # of the pairs of a term in order of length, those with more occurrences than any before
    by_length = np.lexsort((-tf, dls[doc], term))
    most = np.maximum.accumulate(term * (int(tf.max(initial=0)) + 1) + tf[by_length])
    front = by_length[np.concatenate([[True], most[1:] > most[:-1]])] if len(most) else by_length
    used, row = np.unique(bucket[order], return_inverse=True)
    m, last = len(used), np.zeros(1, np.int64)
    fronts, postings = np.bincount(row[term[front]], minlength=m + 1), np.bincount(row[term], minlength=m + 1)
    columns = {
        "bucket": np.append(used, -1), "seg": np.full(m + 1, seg), "grp": [grp] * (m + 1), "terms": _lists(names.take(pa.array(order)).cast(pa.string()), row, m + 1), "ns": _lists(n, row, m + 1),
        "fronts": packed(np.bincount(term[front], minlength=len(names)), np.bincount(row, minlength=m + 1)), "front_tf": packed(tf[front], fronts), "front_dl": packed(dls[doc[front]], fronts),
        "docs": packed(doc, postings), "tfs": packed(tf, postings), "dls": _lists(dls, np.repeat(last + m, len(dls)), m + 1), "ids": _lists(ids, np.repeat(last + m, len(ids)), m + 1),
    }
    columns["bucket"] = pa.array(columns["bucket"].astype(np.int32))
    columns["seg"], columns["grp"] = pa.array(columns["seg"]), pa.array(columns["grp"], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then those of start[1] and so on."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(count.sum()))


def portions(batch: pa.RecordBatch, name: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Some rows of a batch at a time, so many that their lists ``name`` hold about ``most`` values (packed ones: bytes), or one row."""
    length = pc.list_value_length if pa.types.is_list(batch.schema.field(name).type) else pc.binary_length
    part = np.cumsum(pc.fill_null(length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


@dataclass
class Pruned:
    """What a search read and skipped: pairs of segment and query with a term in common, and how many of them were scored."""

    pairs: int = 0
    scored: int = 0


class InvertedIndex:
    """An index under a folder that Spark can read; made by ``write``."""

    def __init__(self, spark: SparkSession, path: str, id: str = "id"):
        self.spark, self.path, self.id = spark, path.rstrip("/"), id
        layout = spark.read.parquet(f"{self.path}/layout").first()
        self.buckets = layout.buckets
        self.rows = spark.read.schema(StructType.fromJson(json.loads(layout.schema))).parquet(f"{self.path}/blocks")
        self.pruned = Pruned()

    @staticmethod
    def write(passages: DataFrame, path: str, id: str = "id", text: str = "text", group: str | None = None, buckets: int = BUCKETS, segment: int = SEGMENT) -> InvertedIndex:
        """Index passages; the folder must not hold an index yet. The layout file comes last: without it there is no index."""
        spark, path = passages.sparkSession, path.rstrip("/")
        tasks = spark.sparkContext.defaultParallelism
        if len(passages.inputFiles()) < tasks:  # a few files, maybe of one row group each, would be made into terms by as few tasks
            passages = passages.repartition(tasks)
        rows = blocks_of(passages, id, text, group, buckets, segment)
        fan = 1 + passages.count() // (segment * FAN)  # files of a folder
        laid = rows.repartition("bucket", F.pmod(F.xxhash64("seg"), F.lit(fan))).sortWithinPartitions("bucket", "seg")
        laid.write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
        spark.createDataFrame([(buckets, segment, laid.schema.json())], "buckets int, segment int, schema string").coalesce(1).write.parquet(f"{path}/layout")
        return InvertedIndex(spark, path, id)

    def segments(self) -> DataFrame:
        """``seg, grp, n, ids, dls`` of each segment."""
        return self.rows.where("bucket = -1").select("seg", "grp", F.size("ids").alias("n"), "ids", "dls")

    def _asked(self, words: pa.Array, group: str | None = None, postings: bool = False) -> DataFrame:
        """``seg, word, n, fronts, front_tf, front_dl`` and with ``postings`` ``docs, tfs`` (packed) of the blocks of some terms, by number; other folders are not read."""
        return self._blocks(words, group, ["front_tf", "front_dl", *(["docs", "tfs"] if postings else [])])

    def _blocks(self, words: pa.Array, group: str | None, lists: list[str]) -> DataFrame:
        """``seg, word, n`` and some lists, packed: ``n`` values of ``docs`` and ``tfs``, and ``fronts``, which comes with them, of ``front_tf`` and ``front_dl``."""
        folders = np.unique(bucket_of(words.to_pylist(), self.buckets)).tolist()
        rows = self.rows.where(F.col("bucket").isin(folders) if len(folders) < self.buckets else F.col("bucket") >= 0)
        rows = rows if group is None else rows.where(F.col("grp") == group)

        counts = ["n", "fronts"] if any(name.startswith("front") for name in lists) else ["n"]

        def run(batches):
            for batch in (some for batch in batches for some in portions(batch, lists[-1] if lists else "terms")):
                terms = pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64)
                word = pc.index_in(batch.column("terms").flatten(), words)
                at, of = np.flatnonzero(np.asarray(word.is_valid())), np.repeat(np.arange(batch.num_rows), terms)
                size = {"n": batch.column("ns").flatten().to_numpy().astype(np.int64)}
                if "fronts" in counts:
                    size["fronts"] = unpacked(batch.column("fronts"), terms).astype(np.int64)
                out = {"seg": batch.column("seg").take(pa.array(of[at])), "word": word.drop_null().cast(pa.int32())} | {c: pa.array(size[c][at].astype(np.int32)) for c in counts}
                for name in lists:
                    n = size["fronts" if name.startswith("front") else "n"]
                    values = unpacked(batch.column(name), np.bincount(of, n, batch.num_rows).astype(np.int64))
                    out[name] = packed(values[ranges((np.cumsum(n) - n)[at], n[at])], n[at])
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        schema = "seg long, word int" + "".join(f", {c} int" for c in counts) + "".join(f", {name} binary" for name in lists)
        return rows.select("seg", "terms", "ns", *counts[1:], *lists).mapInArrow(run, schema)

    def bm25(self, queries: DataFrame, k: int, group: str | None = None, scope: DataFrame | None = None, prune: bool | None = None) -> DataFrame:
        """``query_id, id, score, rank``: the hits of ``search.bm25``, from the blocks of the asked terms alone.

        ``group`` keeps to segments of one group, ``scope`` to the ids of a table; word statistics cover the whole index.
        ``prune`` says whether bounds are used; by default from ``LEAST_SEGMENTS`` segments on.
        """
        said = queries.select("query_id", F.explode(query_terms(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
        asked, found = said.groupBy("query_id").agg(F.collect_list(F.struct("term", "n")).alias("terms")), None
        for block in blocks(asked, "query_id", "query_id", "terms"):
            if block.num_rows and k > 0:
                hits = self._hits(block, k, queries, group, scope, prune)
                found = hits if found is None else found.unionByName(hits)
        found = no_hits(self._id_field(), self.spark, queries) if found is None else found
        return top_k(found, k, F.round(F.col("score"), 9).desc(), F.col(self.id))

    def _id_field(self) -> StructField:
        return StructField(self.id, self.rows.schema["ids"].dataType.elementType)

    def _hits(self, block: pa.Table, k: int, queries: DataFrame, group, scope, prune) -> DataFrame:
        words = Weights.words(block)
        found = self._asked(words, group)
        segments = self.segments()
        size = segments.agg(F.sum("n").alias("n"), F.sum(F.expr("aggregate(dls, 0L, (a, x) -> a + x)")).alias("length"), F.count("*").alias("segments")).first()
        df = np.zeros(len(words), np.int64)
        for r in self._blocks(words, None, []).groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most a row for each asked word
            df[r.word] = r.n
        weights = Weights(block, words, size.n or 0, size.length or 0, df)
        if group is not None:
            segments = segments.where(F.col("grp") == group)
        if scope is not None:
            inside = segments.select("seg", F.posexplode("ids").alias("place", "__id")).join(scope.select(F.col(self.id).alias("__id")).distinct(), "__id", "left_semi")
            segments = segments.join(inside.groupBy("seg").agg(F.collect_list("place").alias("inside")), "seg")
        else:
            segments = segments.withColumn("inside", F.lit(None).cast("array<int>"))
        if prune is False or prune is None and size.segments < LEAST_SEGMENTS:
            return self._scored(words, group, segments.withColumn("mask", F.lit(None).cast("binary")), weights, k, block, queries)
        bounds = kept(self._bounds(found.join(segments.select("seg"), "seg", "left_semi") if scope is not None else found, weights), "bounds")
        first = self._seeds(bounds, weights.queries)
        seeds = segments.join(first, "seg")
        best = top_k(self._scored(words, group, seeds, weights, k, block, queries), k, F.col("score").desc())
        least = np.full(weights.queries, 0.0)
        at = {q: i for i, q in enumerate(block["query_id"].to_pylist())}
        for r in best.where(F.col("rank") == k).select("query_id", "score").collect():  # a number for each query of the block
            least[at[r.query_id]] = r.score - SLACK
        left = kept(self._survivors(bounds, least), "survivors")
        sums = left.agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored")).first()
        self.pruned = Pruned(self.pruned.pairs + (sums.pairs or 0), self.pruned.scored + (sums.scored or 0))
        return self._scored(words, group, segments.join(left.where("scored > 0").select("seg", "mask"), "seg"), weights, k, block, queries)

    def _bounds(self, found: DataFrame, weights: Weights) -> DataFrame:
        """``seg, bound``: for each query (a float each, rounded up) the most that a passage of the segment can score."""

        def bound(table: pa.Table) -> pa.Table:
            size = table["fronts"].to_numpy()
            tf, dl = (unpacked(table[c].combine_chunks(), size) for c in ("front_tf", "front_dl"))
            part = np.maximum.reduceat(weights.part(tf, dl), np.cumsum(size) - size)
            score = weights.scores(np.zeros(len(part), np.int64), table["word"].to_numpy(), part, 1)[0]
            up = np.nextafter(score.astype(np.float32), np.float32(np.inf)) * (score > 0)
            return pa.table({"seg": table["seg"].slice(0, 1), "bound": pa.array([up.astype("<f4").tobytes()])})

        return found.select("seg", "word", "fronts", "front_tf", "front_dl").groupBy("seg").applyInArrow(bound, "seg long, bound binary")

    @staticmethod
    def _seeds(bounds: DataFrame, queries: int) -> DataFrame:
        """``seg, mask``: of each query the segments with the best bounds, from those of each task."""

        def best(batches):
            top, seg = np.zeros((queries, SEEDS), np.float32), np.full((queries, SEEDS), -1, np.int64)
            for batch in batches:
                for s, bound in zip(batch.column("seg").to_pylist(), batch.column("bound").to_pylist(), strict=True):
                    b = np.frombuffer(bound, "<f4")
                    worst = top.argmin(1)
                    better = np.flatnonzero(b > top[np.arange(queries), worst])
                    top[better, worst[better]], seg[better, worst[better]] = b[better], s
            q, i = np.nonzero(seg >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(seg[q, i]), pa.array(top[q, i])], names=["query", "seg", "bound"])

        each = bounds.mapInArrow(best, "query int, seg long, bound float")
        order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "seg")
        chosen = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SEEDS)

        def mask(table: pa.Table) -> pa.Table:
            on = np.zeros(queries, bool)
            on[table["query"].to_numpy()] = True
            return pa.table({"seg": table["seg"].slice(0, 1), "mask": pa.array([np.packbits(on).tobytes()])})

        return chosen.select("query", "seg").groupBy("seg").applyInArrow(mask, "seg long, mask binary")

    @staticmethod
    def _survivors(bounds: DataFrame, least: np.ndarray) -> DataFrame:
        """``seg, mask, pairs, scored``: queries whose bound in a segment reaches their threshold."""

        def run(batches):
            for batch in batches:
                rows = []
                for seg, bound in zip(batch.column("seg").to_pylist(), batch.column("bound").to_pylist(), strict=True):
                    b = np.frombuffer(bound, "<f4")
                    on = (b > 0) & (b >= least)
                    rows.append({"seg": seg, "mask": np.packbits(on).tobytes(), "pairs": int((b > 0).sum()), "scored": int(on.sum())})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("seg", pa.int64()), ("mask", pa.binary()), ("pairs", pa.int64()), ("scored", pa.int64())]))

        return bounds.mapInArrow(run, "seg long, mask binary, pairs long, scored long")

    def _scored(self, words: pa.Array, group: str | None, segments: DataFrame, weights: Weights, k: int, block: pa.Table, queries: DataFrame) -> DataFrame:
        """``query_id, id, score``: of each segment the best of each query that its ``mask`` (null: all) asks for."""
        id, names, n = self.id, block["query_id"].combine_chunks(), weights.queries

        def score(segment: pa.Table, rows: pa.Table) -> pa.Table:
            schema = pa.schema([("query_id", names.type), (id, segment.schema.field("ids").type.value_type), ("score", pa.float64())])
            if not segment.num_rows or not rows.num_rows:
                return schema.empty_table()
            ids, dls = segment["ids"].combine_chunks().flatten(), segment["dls"].combine_chunks().flatten().to_numpy()
            mask, inside = segment["mask"][0].as_py(), segment["inside"][0].as_py()
            count = rows["n"].to_numpy()
            word = np.repeat(rows["word"].to_numpy(), count)
            doc, tf = (unpacked(rows[c].combine_chunks(), count) for c in ("docs", "tfs"))
            if inside is not None:
                allowed = np.zeros(len(dls), bool)
                allowed[inside] = True
                word, doc, tf = word[allowed[doc]], doc[allowed[doc]], tf[allowed[doc]]
            order = np.argsort(doc, kind="stable")
            word, doc, tf = word[order], doc[order], tf[order]
            part, out = weights.part(tf, dls[doc]), []
            on = np.ones(n, bool) if mask is None else np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)
            for a, b in weights.steps(doc, word, len(dls)):
                lo, hi = np.searchsorted(doc, (a, b))
                scores = weights.scores(doc[lo:hi] - a, word[lo:hi], part[lo:hi], b - a) * on
                row, query = largest(scores, k)
                some = scores[row, query] > 0
                out.append((query[some], a + row[some], scores[row, query][some]))
            query, row, value = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table([names.take(pa.array(query)), ids.take(pa.array(row)), pa.array(value)], schema=schema)

        schema = StructType([queries.schema["query_id"], self._id_field(), StructField("score", DoubleType())])
        wanted = segments.select("seg", "ids", "dls", "inside", "mask")
        rows = self._blocks(words, group, ["docs", "tfs"]).join(segments.select("seg"), "seg", "left_semi").select(F.col("seg").alias("of"), "word", "n", "docs", "tfs")
        return wanted.groupBy("seg").cogroup(rows.groupBy("of")).applyInArrow(score, schema)

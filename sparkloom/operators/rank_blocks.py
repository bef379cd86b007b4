"""A graph in blocks for PageRank: nodes numbered within blocks, edges in tiles of one block's outgoing ends.

A block has some ten thousand nodes, and its ranks are one array. A tile holds edges that leave one block, in order of where they go, so
that a round takes a tile and its block's ranks to one sum for each end of the tile. Tiles are laid out once, bucketed by block, and stay
where they are: a round shuffles the arrays of ranks and the sums. Tiles and arrays are bounded, so a node of very many edges has several tiles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import kept, shared_root

#: Nodes of a block and edges of a tile; nodes that are broadcast to name the ends of edges.
BLOCK, TILE, BROADCAST_NODES = 1 << 16, 1 << 18, 100_000
RANKS = "block int, rank binary, degree binary, total double, dangling double"


def numbered(ids: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``id, block, place`` of ``n`` distinct ids, places from 0 in each block, and the number of blocks.

    Blocks have such numbers that each falls into a bucket of its own.
    """
    spark = ids.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    blocks = spark.range(64 * parts).groupBy(bucket.alias("bucket")).agg(F.min("id").cast("int").alias("block"))
    dealt = ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(F.broadcast(blocks), "bucket")
    return kept(dealt.select("id", "block", (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).alias("place")), "numbered"), parts


@contextmanager
def tiles(ids: DataFrame, n: int, edges: DataFrame, parts: int, once: bool) -> Iterator[DataFrame]:
    """``block, src, dst, start`` of ``src, dst`` by id: places of sources in order of their edges' ends, distinct ends, and where each end's sources start."""
    spark = ids.sparkSession
    known = F.broadcast(ids) if n <= BROADCAST_NODES else ids.hint("shuffle_hash")
    end = (F.shiftleft(F.col("block").cast("long"), 32) + F.col("place")).alias("to")
    found = edges.select("src", "dst").join(known.select(F.col("id").alias("dst"), end), "dst").join(known.select(F.col("id").alias("src"), "block", "place"), "src")
    laid = found.select("block", F.col("place").alias("src"), F.col("to").alias("dst")).repartition(parts, "block")
    if once:
        laid = laid.distinct()
    name, path = f"rank_tiles_{uuid.uuid4().hex}", f"{shared_root(spark)}/tiles-{uuid.uuid4().hex}"
    laid.mapInArrow(_tiled, "block int, src binary, dst binary, start binary").write.format("parquet").bucketBy(parts, "block").option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    count: dict[int, int] = {}
    for batch in batches:
        block, src, dst = (batch.column(c).to_numpy() for c in ("block", "src", "dst"))
        for b in np.unique(block).tolist():
            own = block == b
            held.setdefault(b, []).append((src[own], dst[own]))
            count[b] = count.get(b, 0) + int(own.sum())
        while count and sum(count.values()) >= TILE:
            most = max(count, key=count.get)
            count.pop(most)
            yield _tile(most, held.pop(most))
    for b, some in held.items():
        yield _tile(b, some)


def _tile(block: int, some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    src, dst = (np.concatenate([x[i] for x in some]) for i in (0, 1))
    order = np.argsort(dst, kind="stable")
    ends, start = np.unique(dst[order], return_index=True)
    values = (src[order].astype("<i4"), ends.astype("<i8"), start.astype("<i4"))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], names=["block", "src", "dst", "start"])


def _array(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _ranks(block: int, rank: np.ndarray, degree: np.ndarray, total: float) -> pa.Table:
    columns = [pa.array([block], pa.int32()), pa.array([rank.tobytes()], pa.binary()), pa.array([degree.tobytes()], pa.binary()), pa.array([total]), pa.array([float(rank[degree == 0].sum())])]
    return pa.table(columns, names=["block", "rank", "degree", "total", "dangling"])


def begun(first: DataFrame, tiles: DataFrame) -> DataFrame:
    """``RANKS`` of ``block, place, first``: first ranks, numbers of outgoing edges, sum of ranks and of those without edges."""

    def counted(batches):
        for batch in batches:
            for block, src in zip(batch.column("block"), batch.column("src"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([np.bincount(_array(src, "<i4")).astype("<i8").tobytes()], pa.binary())], names=["of", "degree"])

    def begin(nodes: pa.Table, degrees: pa.Table) -> pa.Table:
        rank, degree = np.zeros(nodes.num_rows), np.zeros(nodes.num_rows, "<i8")
        rank[nodes["place"].to_numpy()] = nodes["first"].to_numpy()
        for value in degrees["degree"]:
            part = _array(value, "<i8")
            degree[: len(part)] += part
        return _ranks(nodes["block"][0].as_py(), rank, degree, float(rank.sum()))

    degrees = tiles.select("block", "src").mapInArrow(counted, "of int, degree binary")
    return first.select("block", "place", "first").groupBy("block").cogroup(degrees.groupBy("of")).applyInArrow(begin, RANKS)


def moved(tiles: DataFrame, ranks: DataFrame, base: float, damping: float, scale: float) -> DataFrame:
    """``RANKS`` a round later, ``total`` being what ranks moved; ranks before count ``scale`` times."""

    def give(batches):
        for batch in batches:
            for src, dst, start, rank, degree in zip(*[batch.column(c) for c in ("src", "dst", "start", "rank", "degree")], strict=True):
                share = _array(rank, "<f8") * scale / np.maximum(_array(degree, "<i8"), 1)
                got, ends = np.add.reduceat(share[_array(src, "<i4")], _array(start, "<i4")), _array(dst, "<i8")
                to, place = ends >> 32, (ends & 0xFFFFFFFF).astype("<i4")
                at = np.flatnonzero(np.diff(to, prepend=-1))
                parts = list(zip(at, [*at[1:], len(ends)], strict=True))
                columns = [pa.array(to[at].astype(np.int32)), pa.array([place[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([got[a:b].tobytes() for a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["to", "place", "got"])

    def settle(sums: pa.Table, before: pa.Table) -> pa.Table:
        old, degree = _array(before["rank"][0], "<f8") * scale, _array(before["degree"][0], "<i8")
        got = np.zeros(len(old))
        for place, value in zip(sums["place"], sums["got"], strict=True):
            got[_array(place, "<i4")] += _array(value, "<f8")  # places of one sum are distinct
        rank = base + damping * got
        return _ranks(before["block"][0].as_py(), rank, degree, float(np.abs(rank - old).sum()))

    state = ranks.select("block", "rank", "degree")
    sums = tiles.join(state.hint("shuffle_hash"), "block").mapInArrow(give, "to int, place binary, got binary")
    return sums.groupBy("to").cogroup(state.groupBy("block")).applyInArrow(settle, RANKS)


def named(ids: DataFrame, ranks: DataFrame, scale: float) -> DataFrame:
    """``id, rank`` of all nodes."""

    def name(nodes: pa.Table, state: pa.Table) -> pa.Table:
        rank = _array(state["rank"][0], "<f8") * scale
        return pa.table([nodes["id"].combine_chunks(), pa.array(rank[nodes["place"].to_numpy()])], names=["id", "rank"])

    schema = StructType([ids.schema["id"], StructField("rank", DoubleType())])
    return ids.groupBy("block").cogroup(ranks.select("block", "rank").groupBy("block")).applyInArrow(name, schema)

"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

A vector's signs at ``bits`` fixed random hyperplanes are its bucket in one table. Two vectors at the
angle of the threshold share a bucket of one table with probability p**bits, p = 1 - angle / pi; the
number of tables is chosen so that they miss each other in all with probability ``miss`` at most, and
the number of bits grows with the logarithm of the rows so that buckets of unrelated vectors stay
small. Within a bucket all cosines are computed in double precision as a matrix product; what leaves
it is each vector's number of new links (links not seen in an earlier table) and a spanning forest of
them, so output is linear in the members. A bucket of more than ``block`` vectors is split into blocks
by a hash, and each pair of blocks is a task of its own: no bucket is capped.

Equal vectors are one class with a multiplicity. Null vectors, zero vectors and vectors with null or
non-finite components link with nothing; vectors of different lengths are never compared; an empty
table gives an empty result; a null vec_id never names a component unless all of it is null; other
columns are ignored.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import each_cell, in_cells, least_reached, sides
from .components import connected_components
from .storage import small, stored

COSINE, MISS, BUCKET, BLOCK = 0.9, 0.001, 512, 1024
_SEED = 977


def plan(rows: int, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a table and number of tables for so many rows."""
    bits = min(30, max(4, math.ceil(math.log2(max(rows, 2) / bucket))))
    share = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - share))


def _signs(bits: int, tables: int, kind: str):
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            rows = len(lists)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            at = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null is nan here
            size = np.where(valid, np.diff(at), 0)
            nodes, vecs, sigs, packed = ([None] * rows for _ in range(4))
            for n in np.unique(size[size > 0]).tolist():
                which = np.flatnonzero(size == n)
                x = flat[at[which][:, None] + np.arange(n)]
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                which, x = which[good], x[good]
                if not len(which):
                    continue
                if n not in planes:
                    planes[n] = np.random.default_rng([_SEED, n]).standard_normal((n, bits * tables))
                top = x / np.abs(x).max(1, keepdims=True)
                on = ((top @ planes[n]) >= 0).reshape(len(x), tables, bits)
                key = (on * (1 << np.arange(bits))).sum(2).astype(np.int32)
                for i, row, k, b in zip(which.tolist(), x, key, np.packbits(on.reshape(len(x), -1), axis=1), strict=True):
                    vecs[i] = row.astype(kind).tobytes()
                    nodes[i] = hashlib.md5(row.tobytes()).digest()
                    sigs[i], packed[i] = k, b.tobytes()
            made = [pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *made], names=["vec_id", "node", "vec", "sigs", "signs"])

    return run


_CELL = ["size", "table", "bucket"]


def _same_bucket(signs: np.ndarray, a: np.ndarray, b: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Whether pairs share a bucket in any of the first tables."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 14):
        same = (signs[a[i : i + (1 << 14)]] == signs[b[i : i + (1 << 14)]])[:, : tables * bits]
        out[i : i + (1 << 14)] = same.reshape(len(same), tables, bits).all(2).any(1)
    return out


def _cell_links(cosine: float, kind: str, bits: int):
    def links(cell):
        x = np.frombuffer(b"".join(cell["vec"]), kind).astype(np.float64).reshape(len(cell["vec"]), -1)
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        table = cell["table"][0]
        if (two := sides(cell)) is None:
            a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        else:
            a, b = np.nonzero(x[two[0]] @ x[two[1]].T >= cosine)
            a, b = two[0][a], two[1][b]
        if table and len(a):  # links of earlier tables
            signs = np.unpackbits(np.frombuffer(b"".join(cell["signs"]), np.uint8).reshape(len(x), -1), axis=1)
            old = _same_bucket(signs, a, b, table, bits)
            a, b = a[~old], b[~old]
        if not len(a):
            return None
        copies = np.array(cell["copies"])
        n = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        root, some, node = least_reached(len(x), a, b), np.flatnonzero(n), cell["node"]
        return pa.RecordBatch.from_arrays([pa.array([node[k] for k in some], pa.binary()), pa.array([node[k] for k in root[some]], pa.binary()), pa.array(n[some].astype(np.int64))], names=["node", "root", "n"])

    return each_cell(_CELL, ["node", "vec", "copies", "signs"], links)


def vector_links(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET, block: int = BLOCK):
    """Rows' classes (``vec_id, node``), classes' copies and least ids, links of classes with links, and ``node, root``."""
    bits, tables = plan(vectors.count(), cosine, miss, bucket)
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    signed = stored(vectors.select("vec_id", "embedding").mapInArrow(_signs(bits, tables, kind), "vec_id long, node binary, vec binary, sigs array<int>, signs binary"), "signs")
    kinds = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), *[F.first(c).alias(c) for c in ("vec", "sigs", "signs")])
    kinds = stored(kinds, "vectors").withColumn("size", F.length("vec"))
    slim = kinds.select("size", F.posexplode("sigs").alias("table", "bucket"))
    counts = slim.groupBy("size", "table", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    hot = stored(counts.where(F.col("members") > block), "hot-buckets")
    if hot.count() <= 100_000:
        hot = F.broadcast(hot)
    cells = kinds.select("*", F.posexplode("sigs").alias("table", "bucket")).join(hot, _CELL, "left")
    blocks = F.coalesce(F.ceil(F.col("members") / block), F.lit(1))
    signs = F.expr(f"substring(signs, 1, cast(ceil(table * {bits} / 8) as int))")  # of the tables before
    cells = in_cells(cells.select(*_CELL, "members", "node", "copies", "vec", signs.alias("signs")), _CELL, blocks, F.col("node"))
    found = cells.mapInArrow(_cell_links(cosine, kind, bits), "node binary, root binary, n long")
    found = stored(found, "cell-links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    return signed.select("vec_id", "node"), kinds.select("node", "copies", "least"), links, connected_components(found, "node", "root", "vector-components")


def vector_groups(vectors: DataFrame, **kw) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``."""
    rows, kinds, links, roots = vector_links(vectors, **kw)
    # components are named class by class, so a row meets its class alone
    named = stored(kinds.join(links, "node", "left").join(roots, "node", "left"), "named-vectors")
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(small(least), "root", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    out = rows.join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

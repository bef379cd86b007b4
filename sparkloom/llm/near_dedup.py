"""MinHash near-dedup with ProbMinHash signatures of weighted word shingles.

Every shingle of five words starts a Poisson process whose rate is its weight, ``1 + bonus *
log2(count)``; each arrival falls on a random register, and a register keeps the shingle that comes
first. Arrivals later than the last register's first one cannot matter, so processes end early. The
share of equal registers estimates the probability Jaccard similarity of the weighted sets. Bands of
registers give candidates; a candidate is a link if the exact Jaccard similarity of the sets of
shingles is at least the threshold.

Equal texts are one class from the start. In a bucket every class is compared with one only, the one
that shares most places in buckets, which is the original if the group has one. The components of these
links then leave buckets whose classes are not all connected yet; classes that such buckets hold together
are a cluster, and within a cluster all are compared with all, in blocks and without emitting pairs. So a
group of near copies of one text costs as many comparisons as it has members, and no link that would
connect two components is left out.

Equal texts are copies whatever they hold, and a null text equals an empty one; texts without a word
link with nothing else; texts of one to four words have their words as one shingle;
a null doc_id never names a group unless all of the group's are null; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import each_cell, in_cells, least_reached, sides
from .components import connected_components
from .storage import small, stored
from .words import U64, mix, word_runs

WORDS, THRESHOLD, BANDS, ROWS, BONUS, BLOCK = 5, 0.8, 25, 5, 0.1, 512


def shingles(w, words: int = WORDS):
    """Distinct shingles (48 bits of hash) of each text: text, shingle, count; sorted."""
    size = np.diff(w.offsets)
    doc = w.doc_of()
    n = len(doc)
    start = np.arange(max(0, n - words + 1))
    start = start[doc[: len(start)] == doc[len(doc) - len(start) :]] if n >= words else start[:0]
    short = np.flatnonzero((size > 0) & (size < words))
    h = np.concatenate([w.grams(start, words), w.grams(w.offsets[short], size[short])])
    of = np.concatenate([doc[start], short])
    # texts in a run are far fewer than 2**16
    key = (of.astype(U64) << U64(48)) | (h >> U64(16))
    key, count = np.unique(key, return_counts=True)
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1), count


def prob_min_hash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, docs x registers, of weighted items; a text without items gets zeros."""
    total = np.bincount(doc, weight, docs)
    bound = np.where(total > 0, registers * (np.log(registers) + 3) / np.maximum(total, 1e-300), 0.0)
    out = np.zeros((docs, registers), U64)
    todo = np.flatnonzero(total > 0)
    sub = np.ones(len(doc), bool)
    while len(todo):
        time, sig = _arrivals(doc[sub], item[sub], weight[sub], docs, registers, bound)
        full = time[todo].max(1) < np.inf
        out[todo[full]] = sig[todo[full]]
        todo = todo[~full]  # a register stayed empty: look further ahead
        bound[todo] *= 4
        left = np.zeros(docs, bool)
        left[todo] = True
        sub = left[doc]
    return out


def _arrivals(doc, item, weight, docs, registers, bound):
    time, sig = np.full(docs * registers, np.inf), np.zeros(docs * registers, U64)
    limit = bound.copy()
    now, seed = np.zeros(len(doc)), mix(item + U64(0x5851F42D4C957F2D))
    step = 0
    while len(doc):
        step += 1
        draw = mix(seed + U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        now = now - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        live = now < limit[doc]
        doc, item, weight, now, seed, draw = (x[live] for x in (doc, item, weight, now, seed, draw))
        slot = doc * registers + ((mix(draw) >> U64(32)) * U64(registers) >> U64(32)).astype(np.int64)
        np.minimum.at(time, slot, now)
        won = time[slot] == now
        sig[slot[won]] = item[won]
        limit = np.minimum(limit, time.reshape(docs, registers).max(1))
    return time.reshape(docs, registers), sig.reshape(docs, registers)


def _bands(words, bands, rows, bonus):
    def run(batches):
        for batch in batches:
            for w in word_runs(batch.column("text")):
                doc, item, count = shingles(w, words)
                sig = prob_min_hash(doc, item, 1 + bonus * np.log2(count), w.docs, bands * rows)
                has = np.bincount(doc, minlength=w.docs) > 0
                key = np.zeros((w.docs, bands), U64)
                for r in range(rows):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                key = mix(key + np.arange(bands, dtype=U64))
                here = slice(w.first, w.first + w.docs)
                offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(c)[here] for c in ("doc_id", "node")] + [lists], names=["doc_id", "node", "bands"])

    return run


def _sets(words):
    def run(batches):
        for batch in batches:
            for w in word_runs(batch.column("text")):
                doc, item, _ = shingles(w, words)
                at = np.searchsorted(doc, np.arange(w.docs + 1))
                data = pa.Array.from_buffers(pa.binary(), w.docs, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(item)])
                yield pa.RecordBatch.from_arrays([batch.column("node")[w.first : w.first + w.docs], data], names=["node", "items"])

    return run


def _verify(threshold):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = 0
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def text_node(text="text"):
    """A text's class: 16 bytes of its digest."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def near_links(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bonus: float = BONUS, block: int = BLOCK):
    """The rows' classes (``doc_id, node``) and the ``node, root`` of classes that links connect."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_node().alias("node"))
    signed = stored(texts.mapInArrow(_bands(words, bands, rows, bonus), "doc_id long, node binary, bands array<long>"), "signatures")
    keys = signed.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("key"))
    keys = stored(keys, "bands")
    # buckets of one class are most of all: the counts leave the others only
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keys.join(sizes, "key"), "members")
    # the class that shares most of its buckets' places is the likely original of a group: compare with it
    shared = stored(members.groupBy("node").agg(F.sum("n").alias("shared")), "shared")
    members = stored(members.join(small(shared), "node"), "scored-members")
    hubs = members.groupBy("key").agg(F.max(F.struct("shared", "node")).getField("node").alias("hub"))
    stars = members.join(hubs, "key").where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    # every class in a shared bucket is in a star pair, so these sets serve the second look as well
    one = texts.select("node", "text").join(small(shared.select("node")), "node").dropDuplicates(["node"])
    sets = stored(one.mapInArrow(_sets(words), "node binary, items binary"), "shingle-sets")
    links = stored(_checked(stars, sets, threshold), "links")
    first = stored(connected_components(links), "first-components")
    of = stored(members.select("key", "node").join(small(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "bucket-roots")
    mixed = of.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("least")).where("x < y")
    more = stored(_second_look(of.join(mixed.select("key", "least"), "key"), sets, threshold, block), "more-links")
    return signed.select("doc_id", "node"), connected_components(links.union(more))


def _second_look(left: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """A spanning forest of the links within clusters: classes that buckets of several components hold together.

    A cluster's classes are compared in cells of two blocks, by counting shared shingles as matrix
    products; what cells give is linear in their members.
    """
    loose = stored(connected_components(left.select(F.col("least").alias("a"), F.col("node").alias("b")), name="clusters").withColumnRenamed("root", "cluster"), "loose-clusters")
    held = sets.join(small(loose), "node")
    size = held.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("items")) / (8 << 20))).alias("blocks"))
    cells = in_cells(held.join(small(size), "cluster"), ["cluster"], F.greatest("blocks", F.lit(1)), F.col("node"))
    return cells.mapInArrow(_cell_links(threshold), "a binary, b binary")


def _cell_links(threshold: float):
    def links(cell):
        rows = [np.frombuffer(x, U64) for x in cell["items"]]
        size = np.array([len(x) for x in rows])
        name, column, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        keep = df[column] > 1
        row, column = np.repeat(np.arange(len(rows)), size)[keep], column[keep]
        _, column = np.unique(column, return_inverse=True)
        two = sides(cell) or (np.arange(len(rows)),) * 2
        both = np.zeros((len(two[0]), len(two[1])), np.float32)
        columns = int(column.max(initial=-1)) + 1
        step = min(columns, max(64, (16 << 20) // len(rows)))  # columns at a time
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, columns, step or 1):
            lo, hi = np.searchsorted(column, [first, first + step])
            m = np.zeros((len(rows), step), np.float32)
            m[row[lo:hi], column[lo:hi] - first] = 1
            both += m[two[0]] @ m[two[1]].T
        hit = both >= threshold * (size[two[0]][:, None] + size[two[1]][None, :] - both) - 1e-9
        a, b = np.nonzero(hit & (both > 0))
        a, b = two[0][a], two[1][b]
        a, b = a[a != b], b[a != b]
        root = least_reached(len(rows), a, b)
        some, node = np.flatnonzero(root != np.arange(len(rows))), cell["node"]
        return pa.RecordBatch.from_arrays([pa.array([node[k] for k in some], pa.binary()), pa.array([node[k] for k in root[some]], pa.binary())], names=["a", "b"])

    return each_cell(["cluster"], ["node", "items"], links)


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    x, y = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    return pairs.join(x, "a").join(y, "b").mapInArrow(_verify(threshold), "a binary, b binary")


def near_groups(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, node, root, component_id``: one row per row of ``docs``; component_id is the least doc_id of its group."""
    rows, roots = near_links(docs, **kw)
    # groups are named class by class, so a row meets its class alone
    kinds = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    kinds = stored(kinds.select("node", "least", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "named-texts")
    names = kinds.where("linked").groupBy("root").agg(F.min("least").alias("first"))
    named = kinds.join(small(names), "root", "left").select("node", "root", F.when(F.col("linked"), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(named, "node").select("doc_id", "node", "root", "component_id")


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, component_id, kept``: kept where the row's id is its group's."""
    return near_groups(docs, **kw).select("doc_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the least doc_id stays, nulls last, then the least digest."""
    rows = stored(near_groups(docs, **kw), "groups")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("best"))
    keep = best.select(F.col("best.doc_id").alias("__id"), F.col("best.node").alias("__node"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_node") == F.col("__node"))
    out = docs.withColumn("__text_node", text_node()).join(keep, same, "left_semi")
    if rows.groupBy("doc_id", "node").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "__text_node"])  # repeated rows
    return out.select(*docs.columns)

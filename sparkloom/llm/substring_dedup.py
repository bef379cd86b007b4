"""Substring dedup by De Bruijn compaction of the corpus' word k-mers.

Every run of ``window`` consecutive words is an edge of the graph. An edge belongs to the bucket of
its minimizer, the least of the shorter k-mers in it, so that equal edges share a bucket wherever
they stand; consecutive edges of one text with one minimizer form a path. A path whose words recur
as a whole stays one; a minimizer with differing paths is a branch, and only there are paths taken apart
into edges. Both are found by joins on the minimizer. What recurs is then compacted across minimizers: two
neighbours are joined where the first has no other successor in the corpus and the second no other predecessor
(joins on the neighbours' names give both degrees), and the source coordinates string what is joined into
the longest nonbranching repeats, of equal words and number wherever they stand.

At last the words of each repeat are read at its source coordinates, and their SHA-256 is compared with those of
the other places of the same repeat; a place that agrees with none is no repeat. So hashes of 64 bits find
candidates, and words decide.

Null texts count as empty; a text shorter than the window has no edges; null or repeated doc_ids
are kept apart by a hash of id and text; repeated rows are copies of each other, whose repeats are listed once;
other columns of the input are ignored.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .words import U64, arrow_bytes, mix, ranges, word_runs

WINDOW, SEED, HOT = 35, 12, 1 << 16
_PATH = "row_key long, start int, edges int, seed long, path long"


def _paths(words, window: int, seed: int):
    """Paths of the texts: text, first edge (its first word within the text), edges, minimizer, path hash."""
    n = len(words.hashes)
    if n < window:
        return None
    kmers = words.grams(np.arange(n - seed + 1), seed)
    at = np.arange(len(kmers), dtype=U64)
    width, size = window - seed + 1, 1
    low = (mix(kmers) & ~U64(0xFFFFFF)) | at if len(kmers) < 1 << 24 else None
    if low is None:  # one enormous text: ranks instead of packed positions
        order = np.argsort(mix(kmers), kind="stable")
        low = np.empty(len(kmers), U64)
        low[order] = at
        place = order
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    pos = (low & U64(0xFFFFFF)).astype(np.int64) if len(kmers) < 1 << 24 else place[low.astype(np.int64)]
    doc = words.doc_of()
    edge = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(edge):
        return None
    pos = pos[edge]
    new = np.concatenate([[True], (pos[1:] != pos[:-1]) | (edge[1:] != edge[:-1] + 1)])
    first = np.flatnonzero(new)
    edges = np.diff(np.append(first, len(edge)))
    start, pos = edge[first], pos[first]
    path = words.grams(start, edges + (window - 1))
    path = mix(path ^ mix((pos - start).astype(U64) * U64(4096) + edges.astype(U64)))
    return doc[start], start - words.offsets[doc[start]], edges, kmers[pos], path


def _emit_paths(window, seed):
    def run(batches):
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for w in word_runs(batch.column("text")):
                if (p := _paths(w, window, seed)) is not None:
                    doc, start, edges, seeds, path = p
                    yield pa.RecordBatch.from_arrays([pa.array(keys[w.first + doc]), pa.array(start.astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(seeds.view(np.int64)), pa.array(path.view(np.int64))], names=["row_key", "start", "edges", "seed", "path"])

    return run


def _emit_edges(window):
    """The single edges of branching paths, from the texts that hold them."""

    def run(batches):
        for batch in batches:
            lists = batch.column("paths")
            at, flat = np.asarray(lists.offsets), lists.values
            fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "edges", "seed", "n")}
            keys = batch.column("row_key").to_numpy()
            for w in word_runs(batch.column("text")):
                rows = np.arange(at[w.first], at[w.first + w.docs])
                doc = np.repeat(np.arange(w.docs), np.diff(at[w.first : w.first + w.docs + 1]))
                edges = fields["edges"][rows].astype(np.int64)
                start = ranges(fields["start"][rows].astype(np.int64), edges)
                of = np.repeat(np.arange(len(rows)), edges)
                edge = w.grams(words_at(w, doc[of], start), window)
                yield pa.RecordBatch.from_arrays([pa.array(fields["seed"][rows][of]), pa.array(edge.view(np.int64)), pa.array(fields["n"][rows][of]), pa.array(keys[w.first + doc[of]]), pa.array(start.astype(np.int32))], names=["seed", "edge", "n", "row_key", "start"])

    return run


def words_at(w, doc, start):
    return w.offsets[doc] + start


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a hash that tells rows apart but for repeated ones."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row_key"))


def _of_seeds(rows: DataFrame, seeds: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows whose seed is among ``seeds``, with its columns; those of hot seeds are never gathered by seed."""
    if hot is None:
        return rows.join(seeds, "seed")
    few = seeds.join(F.broadcast(hot), "seed", "left_semi")
    return rows.join(F.broadcast(few), "seed").unionByName(rows.join(F.broadcast(hot), "seed", "left_anti").join(seeds, "seed"))


def repeated_paths(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """``row_key, start, edges, single, kind``: windows (by first word) that start anywhere else as well; ``kind`` names their words.

    Single edges come with one place in each path that repeats as a whole and holds them, so that every kind has two places or more.
    """
    texts = keyed(docs).select("row_key", "text")
    paths = stored(texts.mapInArrow(_emit_paths(window, seed), _PATH), "paths")
    again = stored(paths.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1"), "repeated-seeds")
    many = stored(again.where(F.col("c") > hot).select("seed"), "hot-seeds")
    # as few as their number is large: at most one in ``hot`` paths; beyond what can be broadcast, a shuffle does
    many = many if 0 < many.limit(100_001).count() <= 100_000 else None
    paths = stored(_of_seeds(paths, again.select("seed"), many), "repeated-seed-paths")
    kinds = paths.groupBy("seed", "path").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "start", "edges")).alias("at"))
    kinds = stored(kinds, "path-kinds")
    whole = paths.join(kinds.where("n > 1").select("seed", "path"), ["seed", "path"]).select("row_key", "start", "edges", F.lit(False).alias("single"), F.xxhash64("seed", "path").alias("kind"))
    branch = kinds.groupBy("seed").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("seed")
    parts = _of_seeds(kinds, branch, many).select("at.*", "seed", "n")
    parts = parts.groupBy("row_key").agg(F.collect_set(F.struct("start", "edges", "seed", "n")).alias("paths"))
    edges = stored(texts.join(parts, "row_key").mapInArrow(_emit_edges(window), "seed long, edge long, n long, row_key long, start int"), "branch-edges")
    twice = edges.groupBy("seed", "edge").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("seed", "edge")
    single = edges.join(twice, ["seed", "edge"]).select("row_key", "start", F.lit(1).alias("edges"), F.lit(True).alias("single"), F.xxhash64("edge", "seed").alias("kind"))
    return whole.union(single)


def _compacted(found: DataFrame) -> DataFrame:
    """``row_key, windows``: the longest nonbranching repeats of each text as (start, edges, head)."""
    # the places of a text in order; a text's own length bounds them
    lists = found.groupBy("row_key", "single").agg(F.array_sort(F.collect_set(F.struct("start", "edges", "kind"))).alias("each"))
    before, after = lambda i: F.get("each", i - 1), lambda i: F.get("each", i + 1)
    end = lambda x: x["start"] + x["edges"]
    step = F.transform("each", lambda x, i: F.struct(x["start"].alias("start"), x["edges"].alias("edges"), x["kind"].alias("kind"), F.when(end(before(i)) == x["start"], before(i)["kind"]).alias("prev"), F.when(end(x) == after(i)["start"], after(i)["kind"]).alias("next")))
    steps = stored(lists.select("row_key", "single", F.inline(step)), "steps")
    degrees = steps.groupBy("kind").agg(*[F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in ("prev", "next")])
    degrees = stored(degrees, "degrees")
    ends = degrees.where("next is not null").select(F.col("kind").alias("prev"), F.col("next").alias("kind"))
    joints = degrees.where("prev is not null").join(ends, ["prev", "kind"]).select("kind", F.lit(True).alias("joined"))
    order = Window.partitionBy("row_key", "single").orderBy("start")
    runs = steps.join(joints, "kind", "left").repartition("row_key").withColumn("run", F.count_if(F.col("joined").isNull()).over(order))
    whole = runs.groupBy("row_key", "single", "run").agg(F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges"), F.min_by("kind", "start").alias("head"))
    return stored(whole.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "edges", "head"))).alias("windows")), "repeats")


def _mask(n: int, start, edges, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + edges + (window - 1), n), -1)
    return np.cumsum(step[:n]) > 0


def _rows(batch, *lists: str):
    """Words of each text of a batch, and starts and edges of each of its lists of windows."""
    data, offsets = arrow_bytes(batch.column("text"))
    columns = []
    for name in lists:
        at = batch.column(name)
        columns.append((np.asarray(at.offsets), at.is_valid().to_numpy(zero_copy_only=False), *(at.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "edges"))))
    raw = memoryview(data)
    for i in range(len(offsets) - 1):
        words = bytes(raw[offsets[i] : offsets[i + 1]]).split()
        slots = [slice(offs[i], offs[i + 1]) if valid[i] else slice(0, 0) for offs, valid, _, _ in columns]
        yield i, words, *((c[2][s], c[3][s]) for c, s in zip(columns, slots, strict=True))


def _span_digests(window: int):
    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column("windows").offsets)
            sums = [hashlib.sha256(b" ".join(words[a : a + n + window - 1])).digest() for _, words, (start, edges) in _rows(batch, "windows") for a, n in zip(start.tolist(), edges.tolist(), strict=True)]
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
            flat = batch.column("windows").flatten()
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(of), *(flat.field(k) for k in ("start", "edges", "head")), pa.array(sums, pa.binary())], names=["row_key", "start", "edges", "head", "digest"])

    return run


def _with_windows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    return verified(docs, _compacted(repeated_paths(docs, window, seed)), window)


def verified(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """``row_key, doc_id, text, windows, bad``: rows with their repeats, and those of them whose words agree with no other place."""
    rows = keyed(docs).join(found, "row_key", "left").select("row_key", "doc_id", "text", "windows")
    # both uses of the rows read one shuffle of the texts
    spans = rows.where("windows is not null").mapInArrow(_span_digests(window), "row_key long, start int, edges int, head long, digest binary")
    alone = spans.groupBy("head", "edges", "digest").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min("start").alias("start")).where("n = 1")
    bad = alone.groupBy("row_key").agg(F.collect_list(F.struct("start", "edges")).alias("bad"))
    return rows.join(bad, "row_key", "left")


def _covered(n: int, windows, bad, window: int) -> np.ndarray:
    """The words that windows cover but for the bad ones."""
    start, edges = windows
    if len(bad[0]):
        wrong = set(zip(*(x.tolist() for x in bad), strict=True))
        keep = np.array([w not in wrong for w in zip(start.tolist(), edges.tolist(), strict=True)], bool)
        start, edges = start[keep], edges[keep]
    return _mask(n, start, edges, window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each text without the words that repeated windows cover, joined by one space."""

    def run(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for _, words, windows, bad in _rows(batch, "windows", "bad"):
                left = list(compress(words, ~_covered(len(words), windows, bad, window))) if len(windows[0]) else words
                counts.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    ready = _with_windows(docs, window, seed).select("doc_id", "text", "windows", "bad")
    return ready.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id, start, length, sha256``: the maximal spans of words that repeated windows cover, with a digest of their words."""

    def run(batches):
        for batch in batches:
            out = []
            ids = batch.column("doc_id").to_pylist()
            for i, words, windows, bad in _rows(batch, "windows", "bad"):
                if len(windows[0]):
                    mask = np.diff(_covered(len(words), windows, bad, window).astype(np.int8), prepend=0, append=0)
                    for a, b in zip(np.flatnonzero(mask == 1), np.flatnonzero(mask == -1), strict=True):
                        out.append((ids[i], int(a), int(b - a), hashlib.sha256(b" ".join(words[a:b])).hexdigest()))
            schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    ready = _with_windows(docs, window, seed).where("windows is not null").select("doc_id", "text", "windows", "bad")
    return ready.mapInArrow(run, "doc_id long, start long, length long, sha256 string")

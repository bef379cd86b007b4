"""Phrases whose words occur together more often than their parts would suggest.

Each shard of texts becomes a count trie of at most ``max_words`` levels for each language: a node is a run of words
within a piece, its children the runs that are one word longer. The trie is serialised in path order (the bytes of the
words, parents before children). Sampled paths cut that order into ranges; every trie is cut at the same paths and each
cut carries the nodes above its first path along, so that the tries of a range, merged, know every prefix of every path in
it, however many ranges the children of one common word fill. A walk of the merged trie gives the counts of the left
parts, and suffix links (a join of paths without their first word with paths) those of the right parts.

Texts are lower-cased (A-Z), and cut at ``.,;:!?`` and line ends into pieces and at spaces and tabs into words. Null texts
count as empty, a null language is ``und``, repeated rows count each, ids and other columns are ignored, and an empty table
has no phrases. A shard holds whole texts of ``SHARD_BYTES`` together, or one that is longer.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .words import LOWER, arrow_bytes

MAX_WORDS, MIN_COUNT, TOP, WITHIN = 3, 10, 2000, 50
SHARD_BYTES, RANGE_NODES, MERGE_NODES = 4 << 20, 1 << 20, 1 << 20
SAMPLE_STEP, SAMPLE_PATHS, MOST_RANGES = 2048, 200_000, 1 << 16
_PIECE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r \t"]] = True


@dataclass
class Trie:
    """Nodes in path order: a row of word numbers each (1 and up, 0 beyond its depth), their counts, and the words in byte order."""

    words: pa.LargeBinaryArray
    paths: np.ndarray
    counts: np.ndarray
    carried: np.ndarray

    def depth(self) -> np.ndarray:
        return (self.paths > 0).sum(1)

    def phrases(self, rows: np.ndarray) -> pa.Array:
        """The paths of some nodes, words joined by a space."""
        some = self.paths[rows]
        levels = [self.words.take(pa.array(np.maximum(c, 1) - 1, mask=c == 0)) for c in some.T]
        return pc.binary_join_element_wise(*levels, pa.scalar(b" ", pa.large_binary()), null_handling="skip").cast(pa.large_string()).cast(pa.string())

    def cut(self, a: int, b: int, above: list[int]) -> dict:
        """The nodes from ``a`` to ``b`` and those ``above`` the first path, with the words that they use, as columns of bytes."""
        at = np.concatenate([np.array(above, np.int64), np.arange(a, b)])
        paths = self.paths[at]
        used = np.zeros(len(self.words) + 1, bool)
        used[paths.reshape(-1)] = True
        used[0] = False
        local = np.cumsum(used, dtype=np.int32)
        local[0] = 0
        names = self.words.take(pa.array(np.flatnonzero(used) - 1))
        data, offsets = _buffers(names)
        step = np.diff(local[paths], axis=0, prepend=np.zeros((1, paths.shape[1]), np.int32)).astype("<i4")
        body = np.concatenate([step.T.reshape(-1), self.counts[at].astype("<i8").view("<i4"), np.diff(offsets).astype("<i4")])
        body = np.ascontiguousarray(body.view(np.uint8).reshape(-1, 4).T).tobytes()
        return {"nodes": len(at), "carried": len(above), "words": pa.compress(data, "zstd", asbytes=True), "n_words": len(names), "words_bytes": len(data), "body": pa.compress(body, "zstd", asbytes=True)}


def _buffers(names: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    data = names.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(names) else b""
    return data, offsets


def _opened(row: dict, levels: int) -> Trie:
    """What ``Trie.cut`` wrote."""
    n, k = row["nodes"], row["n_words"]
    body = np.frombuffer(pa.decompress(row["body"], 4 * (n * (levels + 2) + k), "zstd"), np.uint8).reshape(4, -1).T
    body = np.ascontiguousarray(body).view("<i4").reshape(-1)
    paths = np.cumsum(body[: n * levels].reshape(levels, n).T, axis=0, dtype=np.int32)
    counts = np.ascontiguousarray(body[n * levels : n * (levels + 2)]).view("<i8").copy()
    offsets = np.concatenate([[0], np.cumsum(body[n * (levels + 2) :], dtype=np.int64)])
    data = pa.decompress(row["words"], row["words_bytes"], "zstd") if k else pa.py_buffer(b"")
    return Trie(pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(offsets), data]), paths, counts, np.arange(n) < row["carried"])


def _numbers(paths: np.ndarray, base: int) -> np.ndarray:
    """One number a row, in path order."""
    out, top = paths[:, 0].astype(np.int64), base
    for level in range(1, paths.shape[1]):
        if top > (1 << 62) // base:
            out = np.unique(out, return_inverse=True)[1]
            top = int(out.max(initial=0)) + 1
        out, top = out * base + paths[:, level], top * base
    return out


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and the number (from 1) of each."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _words(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words in ``data`` and the number of the piece of each."""
    data = LOWER[data]
    gap = np.concatenate([[True], _BREAK[data], [True]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    kept = data[~gap[1:-1]]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]), np.cumsum(_PIECE[data])[start]


def count_trie(data: np.ndarray, levels: int) -> tuple[int, Trie]:
    """Number of words of texts (joined by line ends), and their trie."""
    words, piece = _words(data)
    names, code = _ranked(words)
    base = len(names) + 1
    runs = [np.flatnonzero(piece[: len(code) - depth + 1] == piece[depth - 1 :]) for depth in range(1, min(levels, len(code)) + 1)]
    if base**levels < 1 << 62:  # a path is a number
        found = np.concatenate([np.zeros(0, np.int64), *(sum(code[at + i] * base ** (levels - 1 - i) for i in range(depth)) for depth, at in enumerate(runs, 1))])
        found.sort()
        first, counts = _runs(found)
        number, paths = found[first], np.zeros((len(first), levels), np.int32)
        for level in reversed(range(levels)):
            number, paths[:, level] = np.divmod(number, base)
    else:
        paths = np.zeros((sum(map(len, runs)), levels), np.int32)
        row = 0
        for depth, at in enumerate(runs, 1):
            for level in range(depth):
                paths[row : row + len(at), level] = code[at + level]
            row += len(at)
        _, first, counts = np.unique(_numbers(paths, base), return_index=True, return_counts=True)
        paths = paths[first]
    return len(code), Trie(names, paths, counts.astype(np.int64), np.zeros(len(counts), bool))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(ordered)))


def merged(tries: list[Trie]) -> Trie:
    """One trie with the sums of the counts."""
    if len(tries) == 1:
        return tries[0]
    names, code = _ranked(pa.concat_arrays([t.words for t in tries]))
    paths, at = [], 0
    for t in tries:
        of = np.concatenate([[0], code[at : at + len(t.words)]]).astype(np.int32)
        paths.append(of[t.paths])
        at += len(t.words)
    paths = np.concatenate(paths)
    numbers = _numbers(paths, len(names) + 1)
    order = np.argsort(numbers, kind="stable")  # merges sorted runs
    first, _ = _runs(numbers[order])
    counts = np.add.reduceat(np.concatenate([t.counts for t in tries])[order], first) if len(first) else np.zeros(0, np.int64)
    return Trie(names, paths[order[first]], counts, np.concatenate([t.carried for t in tries])[order[first]])


def walk(trie: Trie, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of their own range with a count of ``least`` or more: rows, depths, and the counts of their prefixes by depth."""
    depth, levels = trie.depth(), trie.paths.shape[1]
    place, prefix = np.arange(len(depth)), np.zeros((len(depth), levels), np.int64)
    for d in range(1, levels):
        above = np.maximum.accumulate(np.where(depth == d, place, -1))
        deep = depth > d
        prefix[deep, d - 1] = trie.counts[above[deep]]
    rows = np.flatnonzero((trie.counts >= least) & ~trie.carried)
    return rows, depth[rows], prefix[rows]


def tries(docs: DataFrame, levels: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, n, nodes, carried, words, n_words, words_bytes, body, sample``: the serialised trie of each shard and language."""

    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, parts in held.items():
                n, trie = count_trie(np.concatenate(parts), levels)
                if n:
                    sample = trie.phrases(np.arange(n % SAMPLE_STEP, len(trie.counts), SAMPLE_STEP))
                    row = {"lang": lang, "n": n, **trie.cut(0, len(trie.counts), []), "sample": sample.to_pylist()}
                    yield pa.RecordBatch.from_pylist([row], schema=out)

        for batch in batches:
            langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
            data, offsets = arrow_bytes(batch.column("text"))
            for i, lang in enumerate(langs.indices.to_pylist()):
                part = data[offsets[i] : offsets[i + 1]]
                if len(part):
                    held.setdefault(langs.dictionary[lang].as_py(), []).append(np.concatenate([part, [10]]).astype(np.uint8))
                    size += len(part) + 1
                if size >= shard_bytes:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    out = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("nodes", pa.int64()), ("carried", pa.int64()), ("words", pa.binary()), ("n_words", pa.int64()), ("words_bytes", pa.int64()), ("body", pa.binary()), ("sample", pa.list_(pa.string()))])
    return docs.select("lang", "text").mapInArrow(run, "lang string, n long, nodes long, carried long, words binary, n_words long, words_bytes long, body binary, sample array<string>")


def cuts(shards: DataFrame, range_nodes: int = RANGE_NODES) -> list[tuple[str, list[bytes]]]:
    """Language and path at which each range but the first begins: quantiles of the sampled paths.

    They only balance the ranges. The driver takes at most about ``SAMPLE_PATHS`` of them, and makes at most ``MOST_RANGES`` ranges.
    """
    total = shards.agg(F.sum("nodes").alias("nodes"), F.sum(F.size("sample")).alias("paths")).first()
    ranges = min(MOST_RANGES, -(-(total.nodes or 0) // range_nodes))
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE_PATHS / max(1, total.paths))
    some = shards.select("lang", F.explode("sample").alias("path")).where(F.pmod(F.xxhash64("lang", "path"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = sorted((r.lang.encode(), r.path.encode().split(b" ")) for r in some.collect())
    picked = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return [(lang.decode(), path) for i, (lang, path) in enumerate(picked) if not i or (lang, path) != picked[i - 1]]


def _places(trie: Trie, path: list[bytes], names: list[bytes], numbers: np.ndarray, base: int) -> tuple[int, list[int]]:
    """Place of the first node that is not before ``path``, and those of the path's proper prefixes."""
    codes = np.zeros((1, trie.paths.shape[1]), np.int64)
    above, exact = [], True
    for level, word in enumerate(path):
        at = bisect_left(names, word)
        codes[0, level] = at + 1
        exact = at < len(names) and names[at] == word
        if not exact:
            break
        if level + 1 < len(path):
            place = int(np.searchsorted(numbers, _pack(codes, base)[0]))
            if place < len(numbers) and (trie.paths[place] == codes[0]).all():
                above.append(place)
            else:
                exact = False
                break
    return int(np.searchsorted(numbers, _pack(codes, base)[0])), above


def _pack(paths: np.ndarray, base: int) -> np.ndarray:
    """Rows as numbers of any size in path order."""
    out = paths[:, 0].astype(object if base ** paths.shape[1] > 1 << 62 else np.int64)
    for level in range(1, paths.shape[1]):
        out = out * base + paths[:, level].astype(out.dtype)
    return out


def _each(batches):
    """The rows of batches one by one: blobs are copied when they are used."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        pa.default_memory_pool().release_unused()


def by_range(shards: DataFrame, bounds: list[tuple[str, list[bytes]]], levels: int) -> DataFrame:
    """``range, lang`` and the cut of each trie that falls into the range."""
    out = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("nodes", pa.int64()), ("carried", pa.int64()), ("words", pa.binary()), ("n_words", pa.int64()), ("words_bytes", pa.int64()), ("body", pa.binary())])
    keys = [lang.encode() for lang, _ in bounds]

    def run(batches):
        for row in _each(batches):
            trie, lang = _opened(row, levels), row["lang"].encode()
            names, base = trie.words.to_pylist(), len(trie.words) + 1
            numbers = _pack(trie.paths, base)
            lo = bisect_left(keys, lang)
            hi = bisect_left(keys, lang + b"\x00")
            placed = [(0, []), *(_places(trie, path, names, numbers, base) for _, path in bounds[lo:hi]), (len(numbers), [])]
            del names, numbers
            for i, ((a, above), (b, _)) in enumerate(zip(placed[:-1], placed[1:], strict=True)):
                if a < b or above:
                    yield pa.RecordBatch.from_pylist([{"range": lo + i, "lang": row["lang"], **trie.cut(a, b, above)}], schema=out)

    return shards.select("lang", "nodes", "carried", "words", "n_words", "words_bytes", "body").mapInArrow(run, "range int, lang string, nodes long, carried long, words binary, n_words long, words_bytes long, body binary")


def counted(cut: DataFrame, ranges: int, least: int, levels: int) -> DataFrame:
    """``lang, phrase, depth, f, lefts`` of the nodes of all merged tries that occur ``least`` times or more.

    The tries of a range come one after the other and are merged whenever they hold ``MERGE_NODES`` nodes together.
    """

    def run(batches):
        key, held, size = None, [], 0

        def flush():
            trie = merged(held)
            rows, depth, prefix = walk(trie, least)
            for a in range(0, len(rows), 20_000):
                some = slice(a, a + 20_000)
                lefts = [p[: d - 1] for p, d in zip(prefix[some].tolist(), depth[some].tolist(), strict=True)]
                columns = [pa.array([key[1]] * len(lefts), pa.string()), trie.phrases(rows[some]), pa.array(depth[some], pa.int32()), pa.array(trie.counts[rows[some]]), pa.array(lefts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "depth", "f", "lefts"])

        for row in _each(batches):
            if held and (row["range"], row["lang"]) != key:
                yield from flush()
                held, size = [], 0
            key = row["range"], row["lang"]
            held.append(_opened(row, levels))
            size += row["nodes"]
            if size >= MERGE_NODES and len(held) > 1:
                held = [merged(held)]
                size = len(held[0].counts) // 2  # what is merged twice doubles at least in between
        if held:
            yield from flush()

    together = cut.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lang") if ranges > 1 else cut.coalesce(1).sortWithinPartitions("range", "lang")
    return together.mapInArrow(run, "lang string, phrase string, depth int, f long, lefts array<long>")


def _scored(left: str = "lefts", right: str = "rights") -> Column:
    """The lowest score over the cuts, exact while a squared and a million times that stay below 10**38, and the first cut that has it."""
    return F.expr(f"""array_min(transform({left}, (l, i) -> struct(
      (cast(f as decimal(19, 0)) * cast(f as decimal(19, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(19, 0)) * cast({right}[i] as decimal(19, 0))) as score,
      i as k, l, {right}[i] as r)))""")


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, within: int = WITHIN, shard_bytes: int = SHARD_BYTES, range_nodes: int = RANGE_NODES) -> DataFrame:
    """``lang, phrase, words, a, k, l, r, n, score, inside``: every phrase of 2 to ``max_words`` words that occurs ``least`` times or more.

    ``inside`` tells whether a longer one that holds its words in turn has ``within`` percent of its count or more.
    """
    shards = stored(tries(docs, max_words, shard_bytes), "tries")
    bounds = cuts(shards, range_nodes)
    nodes = stored(counted(by_range(shards, bounds, max_words), len(bounds) + 1, least, max_words), "phrases")
    level = nodes.where("depth = 1").select("lang", "phrase", "f", F.array().cast("array<long>").alias("rights"))
    found = None
    for depth in range(2, max_words + 1):
        suffix = level.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rights").alias("rights"))
        own = nodes.where(F.col("depth") == depth).withColumn("suffix", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
        level = own.join(suffix, ["lang", "suffix"]).select("lang", "phrase", "depth", "f", "lefts", "rights", "suffix")
        found = level if found is None else found.unionByName(level)
    # a phrase in a much longer one is in one that is a word longer, and that one occurs as often at least
    held = nodes.where("depth > 2").select("lang", "f", F.explode(F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', depth - 1)"))).alias("phrase"))
    longer = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    size = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    out = found.join(longer, ["lang", "phrase"], "left").withColumn("best", _scored()).join(size, "lang")
    inside = F.coalesce(F.col("longer"), F.lit(0)) * 100 >= F.col("f") * within
    return out.select("lang", "phrase", F.col("depth").alias("words"), F.col("f").alias("a"), (F.col("best.k") + 1).alias("k"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"), inside.alias("inside"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language that are not inside of longer ones, by score, count and bytes of the phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.where("not inside").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.withColumn("rank", F.col("rank").cast("long"))

"""Benchmark decontamination by greedy string tiling.

Every run of ``least`` words of the test items is a seed. A text and an item that share a seed are a
pair. A pair is tiled by running Karp-Rabin: for match lengths from the longest downwards, the hashes of all runs of that
many unmarked words come from prefix sums on both sides, equal runs are compared, marked and never used again, until only runs
shorter than ``least`` are left. Tiles may stand in any order, so reordered passages count. The share of the item's words
under tiles is its coverage; a pair of at least ``coverage`` is a leak.

Not every seed makes pairs. A leak shares so many words with its item that it shares at least a certain number of seeds s of
the item's m; so it shares one of any m - s + 1, and only the item's rarest m - s + 1 seeds are looked up. A phrase that
very many items or texts hold makes no pairs by itself, and no leak is lost.

While the items have at most ``broadcast_words`` words, they are broadcast, and each text is looked up and tiled where it is read;
texts are never shuffled. Beyond, seeds meet in a join on their hash.

Words are compared without ASCII case. Items of fewer than ``least`` words are one seed and one tile
of their own; items without a word are never found; null or empty texts leak nothing; repeated rows and
items are judged each; an empty table on either side gives an empty result; other columns are
ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .words import U64, Words, run_hashes, sequence_hashes, word_runs

LEAST, COVERAGE, BROADCAST_WORDS, BROADCAST_BYTES = 5, 0.5, 1 << 20, 32 << 20
_FOUND = "item_words long, matched long, tiles long, first long, last long"


def tile(text: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in text, start in item, length), longest first."""
    n, m = len(text), len(item)
    least = max(1, min(least, m))
    tiles: list[tuple[int, int, int]] = []
    if n < least:
        return tiles
    free_t, free_i = np.isin(text, item), np.ones(m, bool)  # words that the item lacks never match
    sums_t, sums_i = sequence_hashes(text), sequence_hashes(item)

    def longest(mask):
        edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
        return int((edge[1::2] - edge[::2]).max(initial=0))

    def runs(mask, size):
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.flatnonzero(total[size:] - total[:-size] == size)

    size = min(longest(free_t), m)
    while size >= least:
        ti, it = runs(free_t, size), runs(free_i, size)
        th, ih = run_hashes(sums_t, ti, size), run_hashes(sums_i, it, size)
        order = np.argsort(ih, kind="stable")
        ih, it = ih[order], it[order]
        lo, hi = np.searchsorted(ih, th, "left"), np.searchsorted(ih, th, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            a = int(ti[k])
            if not free_t[a : a + size].all():
                continue
            for b in it[lo[k] : hi[k]].tolist():
                if free_i[b : b + size].all() and (text[a : a + size] == item[b : b + size]).all():
                    tiles.append((a, b, size))
                    free_t[a : a + size] = free_i[b : b + size] = False
                    break
        size = min(size - 1, longest(free_t), longest(free_i))
    return tiles


def _row(text: np.ndarray, item: np.ndarray, least: int) -> tuple:
    found = tile(text, item, least)
    return len(item), sum(x[2] for x in found), len(found), min((x[0] for x in found), default=None), max((x[0] + x[2] for x in found), default=None)


def _starts(doc: np.ndarray, size: int) -> np.ndarray:
    """First words of the runs of ``size`` words within one text."""
    start = np.arange(max(0, len(doc) - size + 1))
    return start[doc[: len(start)] == doc[len(doc) - len(start) :]]


def _seeds_of(w: Words, least: int):
    size, doc = np.diff(w.offsets), w.doc_of()
    start, short = _starts(doc, least), np.flatnonzero((size > 0) & (size < least))
    return np.concatenate([doc[start], short]), np.concatenate([w.grams(start, least), w.grams(w.offsets[short], size[short])])


def seeds_needed(words: int, least: int, coverage: float) -> int:
    """How many seeds (by place) of an item of so many words a leak shares at least: each covers ``least`` words at most."""
    return max(1, math.ceil((coverage * words - 1e-9) / min(least, max(1, words))))


class Items:
    """Test items as word hashes, and a sorted table of their rarest seeds."""

    def __init__(self, texts: pa.Array, least: int, coverage: float):
        self.least, self.coverage = least, coverage
        runs = list(word_runs(texts, fold=True))
        self.hashes = [w.hashes[w.offsets[i] : w.offsets[i + 1]].copy() for w in runs for i in range(w.docs)]
        pairs = [_seeds_of(w, least) for w in runs]
        item = np.concatenate([np.zeros(0, np.int64), *[w.first + of for w, (of, _) in zip(runs, pairs, strict=True)]])
        seed = np.concatenate([np.zeros(0, U64), *[h for _, h in pairs]])
        words = np.array([len(h) for h in self.hashes], np.int64)
        self.shorts = sorted({int(n) for n in words if 0 < n < least})
        # each item's seeds from the one that fewest items hold
        name, of, = np.unique(seed, return_inverse=True)
        holders = np.bincount(np.unique(np.stack([of, item]), axis=1)[0], minlength=len(name)) if len(seed) else np.zeros(0, int)
        order = np.lexsort((seed, holders[of], item))
        item, seed = item[order], seed[order]
        first = np.searchsorted(item, np.arange(len(words) + 1))
        place = np.arange(len(item)) - first[item]
        kept = np.array([m - seeds_needed(int(n), least, coverage) + 1 for m, n in zip(np.diff(first), words, strict=True)], np.int64)
        some = place < kept[item] if len(item) else np.zeros(0, bool)
        order = np.argsort(seed[some], kind="stable")
        self.seeds, self.items = seed[some][order], item[some][order]

    def pairs(self, w: Words) -> np.ndarray:
        """Distinct (text, item) that share a rare seed."""
        doc, keys = w.doc_of(), [np.zeros(0, np.int64)]
        for size in (self.least, *self.shorts):
            start = _starts(doc, size)
            h = w.grams(start, size)
            lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
            hit = np.flatnonzero(hi > lo)
            count = hi[hit] - lo[hit]
            at = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            keys.append(np.unique(np.repeat(doc[start[hit]], count) * len(self.hashes) + self.items[at]))
        return np.stack(np.divmod(np.unique(np.concatenate(keys)), max(1, len(self.hashes))), 1)

    def leaks(self, texts: pa.Array):
        """(row, item, words, matched, tiles, first, last) of every leak."""
        for w in word_runs(texts, fold=True):
            for d, i in self.pairs(w).tolist():
                found = _row(w.hashes[w.offsets[d] : w.offsets[d + 1]], self.hashes[i], self.least)
                if found[1] >= self.coverage * found[0] - 1e-9:
                    yield w.first + d, i, *found


def _prepared(benchmark: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return stored(benchmark.select("item_id", text.alias("item"), F.xxhash64("item_id", text).alias("item_key")), "items")


def _broadcast(items: DataFrame, least: int, coverage: float, most: int):
    """The broadcast ``Items`` and their ids, or None where they are too many."""
    words, size = items.agg(F.sum(F.regexp_count("item", F.lit(r"[^\x20\x09-\x0D]+"))), F.sum(F.octet_length("item"))).first()
    if (words or 0) > most or (size or 0) > BROADCAST_BYTES:
        return None
    table = items.select("item_id", "item").toArrow()
    made = Items(table["item"].combine_chunks().cast(pa.large_string()), least, coverage)
    return items.sparkSession.sparkContext.broadcast((made, table["item_id"].combine_chunks()))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row_key"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``doc_id, row_key, item_id, item_words, matched, tiles, first, last, coverage`` of every leak.

    ``first`` and ``last`` bound the tiles among the text's words.
    """
    items = _prepared(benchmark)
    shared = _broadcast(items, least, coverage, broadcast_words)
    made = _looked_up(docs, shared) if shared else _joined(docs, items, least, coverage)
    return made.select("doc_id", "row_key", "item_id", "item_words", "matched", "tiles", "first", "last", (F.col("matched") / F.col("item_words")).alias("coverage"))


def _looked_up(docs: DataFrame, shared) -> DataFrame:
    def run(batches):
        items, names = shared.value
        for batch in batches:
            out = list(items.leaks(batch.column("text")))
            rows, of = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
            made = [pa.array([x[k] for x in out], pa.int64()) for k in range(2, 7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("row_key").take(rows), names.take(of), *made], names=["doc_id", "row_key", "item_id", "item_words", "matched", "tiles", "first", "last"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row_key long, item_id long, " + _FOUND)


def _item_seeds(least: int, coverage: float):
    """Seeds of each item: hash, item, words of the item, and how many places hold it."""

    def run(batches):
        for batch in batches:
            keys = batch.column("item_key")
            for w in word_runs(batch.column("item"), fold=True):
                of, seed = _seeds_of(w, least)
                words = np.diff(w.offsets)
                need = np.array([max(0, (max(1, n - least + 1)) - seeds_needed(int(n), least, coverage) + 1) for n in words], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), keys.take(pa.array(w.first + of)), pa.array(need[of]), pa.array(words[of])], names=["seed", "item_key", "kept", "words"])

    return run


def _text_seeds(least: int, shorts):
    def run(batches):
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for w in word_runs(batch.column("text"), fold=True):
                doc = w.doc_of()
                for size in (least, *shorts):
                    start = _starts(doc, size)
                    yield pa.RecordBatch.from_arrays([pa.array(w.grams(start, size).view(np.int64)), pa.array(keys[w.first + doc[start]])], names=["seed", "row_key"])

    return run


def _tiles(least: int):
    def run(batches):
        for batch in batches:
            hashes = {}
            for column in ("text", "item"):
                hashes[column] = [None] * batch.num_rows
                for w in word_runs(batch.column(column), fold=True):
                    for i in range(w.docs):
                        hashes[column][w.first + i] = w.hashes[w.offsets[i] : w.offsets[i + 1]].copy()
            out = [_row(t, i, least) for t, i in zip(hashes["text"], hashes["item"], strict=True)]
            made = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row_key", "item_id")] + made, names=["doc_id", "row_key", "item_id", "item_words", "matched", "tiles", "first", "last"])

    return run


def _joined(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Leaks by a join of texts and items on the items' rarest seeds, rare among texts and items together."""
    texts = _keyed(docs)
    seeds = stored(items.dropDuplicates(["item_key"]).mapInArrow(_item_seeds(least, coverage), "seed long, item_key long, kept long, words long"), "item-seeds")
    shorts = sorted(r.words for r in seeds.where(F.col("words") < least).select("words").distinct().collect())  # fewer than ``least`` numbers
    # texts' seeds that items have, once for each text
    hits = texts.select("row_key", "text").mapInArrow(_text_seeds(least, shorts), "seed long, row_key long").join(seeds.select("seed").distinct(), "seed", "left_semi")
    hits = stored(hits.distinct(), "text-seeds")
    held = hits.groupBy("seed").agg(F.count("*").alias("texts"))
    ranked = seeds.join(held, "seed", "left").groupBy("item_key", "kept", "seed").agg(F.count("*").alias("places"), F.max(F.coalesce("texts", F.lit(0))).alias("texts"))
    # an item's seeds in order, by place: those that begin within the first ``kept`` places
    lists = ranked.groupBy("item_key", "kept").agg(F.array_sort(F.collect_list(F.struct("texts", "seed", "places"))).alias("each"))  # bounded by the item
    before = lambda i: F.aggregate(F.slice("each", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["places"])
    rare = lists.select("item_key", F.explode(F.filter(F.transform("each", lambda x, i: F.struct(x["seed"].alias("seed"), before(i).alias("at"))), lambda x: x["at"] < F.col("kept"))).alias("x"))
    rare = stored(rare.select("item_key", "x.seed"), "rare-seeds")
    pairs = stored(hits.join(rare, "seed").select("row_key", "item_key").distinct(), "pairs")
    both = pairs.join(texts, "row_key").join(items, "item_key").select("doc_id", "row_key", "text", "item_id", "item")
    made = both.mapInArrow(_tiles(least), "doc_id long, row_key long, item_id long, " + _FOUND)
    return made.where((F.col("item_words") > 0) & (F.col("matched") >= coverage * F.col("item_words") - 1e-9))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    items = _prepared(benchmark)
    shared = _broadcast(items, least, coverage, broadcast_words)
    if shared is None:
        bad = _joined(docs, items, least, coverage).select(F.col("row_key").alias("__row_key")).distinct()
        key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
        return docs.withColumn("__row_key", key).join(bad, "__row_key", "left_anti").select(*docs.columns)

    def run(batches):
        items, _ = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[x[0] for x in items.leaks(batch.column("text"))]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)

"""Token ids of whole texts in a binary shard format, compressed by a Re-Pair grammar per shard.

Texts are ordered by ``doc_id`` (nulls first, equal ids by text), cut into shards of a bounded
number of ids, and each shard is one self-contained blob::

    "RPR2" | 8 x uint64: vocabulary, texts, rules, symbols, ids, symbol width, step, 0
    rules    2 x uint32 each: the pair a nonterminal stands for
    lengths  uint32 each: ids a nonterminal expands to
    symbols  uint16 or uint32: the compressed sequence; no pair spans two texts
    sums     uint64 each: id at which every step-th symbol starts
    doc_id   int64 each | valid uint8 each (0: the id is null)
    first    uint64 each and one more: symbol at which a text starts
    at       uint64 each and one more: id at which a text starts

The blobs are the rows of a Parquet table, so that Spark's writer commits them whole, any file
system will do, and lost executors cost nothing but time. ``Shard`` decodes any text or range
of ids of a shard by the stored sums and lengths: it reads the symbols of that text or range, and the rules they use.

Null texts count as empty; an empty text has the end id alone; repeated rows are encoded each;
an empty table gives an empty store; other columns are ignored.
"""

import itertools
import json
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shared_root, stored
from .words import LOWER, byte_hashes, ranges, slices, spans

END_ID = 2
SHARD_IDS = 1 << 20
LEAST_COUNT, SPREAD, RULES, STEP = 8, 16, 1 << 16, 1024
_HEAD = 4 + 8 * 8
_MEMO_WORDS, _SLOT_BITS, _SLICE = 1_200_000, 22, 2 << 20
_SLOTS = 1 << _SLOT_BITS


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


#: How byte-level tokenizers write the bytes that are not printable Latin-1: as code points from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class WordEncoder:
    """Encodes texts word by word, and each word once for as long as the memo holds it.

    It serves tokenizers that drop white space and split at it, fold case, and part a letter or digit
    from the comma or full stop after it (``WORDWISE``); for these the ids of a text are those of its words in turn,
    which the tests compare. The memo is a table with two slots a word, keyed by 64 bits of hash; it
    is bounded, and lives with the Python worker.
    """

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer = tokenizer
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end_id = end_id
        self._clear()

    def _clear(self):
        self.slots = np.zeros((2, _SLOTS), np.int32)
        self.words = self.used = 1  # entry 0: the end id
        self.ids = np.full(1 << 16, self.end_id, np.uint32)
        self.hash, self.at, self.size = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]):
        coded = self._ids(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        total, n = int(sizes.sum()), len(words)
        self.ids = _room(self.ids, self.used + total)
        self.hash, self.at, self.size = (_room(x, self.words + n) for x in (self.hash, self.at, self.size))
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(coded), np.uint32, total)
        new = np.arange(self.words, self.words + n)
        self.hash[new], self.size[new], self.at[new] = hashes, sizes, self.used + np.cumsum(sizes) - sizes
        one, two = self._places(hashes)
        free = self.slots[0][one] == 0
        self.slots[0][one[free]] = new[free]
        self.slots[1][two[~free]] = new[~free]
        self.words, self.used = self.words + n, self.used + total
        return new

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words; those of Latin-1 letters go to the tokenizer's model at once, others through all its steps."""
        out, rest, split = [], [], self.tokenizer.model.tokenize
        for word in words:
            if word.isalpha() and max(word) <= "\xff":
                word = word.lower()
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                out.append([t.id for t in split(letters)])
            else:
                rest.append(len(out))
                out.append(word)
        for i, e in zip(rest, self.tokenizer.encode_batch([out[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    @staticmethod
    def _places(hashes):
        return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)

    def _entries(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = self._places(hashes)
        entry = self.slots[0][one].astype(np.int64)
        miss = np.flatnonzero(self.hash[entry] != hashes)
        other = self.slots[1][two[miss]]
        entry[miss] = other
        miss = miss[self.hash[other] != hashes[miss]]
        if len(miss):
            new, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(start[miss[first]].tolist(), end[miss[first]].tolist(), strict=True)]
            entry[miss] = self._learn(new, words)[inverse]
        return entry

    def encode(self, texts: pa.Array):
        """For some consecutive texts at a time: first row, ids of all, ids of each text with its end id."""
        for first, data, offsets in slices(texts, _SLICE):
            if b"<|" not in data.tobytes():  # such marks are told apart by case
                data = LOWER[data]
            start, end, at = spans(data, offsets)
            docs = len(offsets) - 1
            cut = np.zeros(len(start), bool)
            if len(start):
                cut = (end - start > 1) & _STOP[data[end - 1]] & _ALNUM[data[end - 2]]
            parts = 1 + cut
            place = np.cumsum(parts) - parts
            a, b = np.repeat(start, parts), np.repeat(end, parts)
            b[place[cut]] -= 1
            a[place[cut] + 1] = b[place[cut] + 1] - 1
            at = np.append(place, len(a))[at]
            if self.words + len(a) // 4 > _MEMO_WORDS:
                self._clear()
            of = np.repeat(np.arange(docs), np.diff(at))
            entry = np.zeros(len(a) + docs, np.int64)
            entry[np.arange(len(a)) + of] = self._entries(byte_hashes(data, a, b), data, a, b)
            sizes, places = self.size[entry], self.at[entry]
            bound = np.concatenate([[0], np.cumsum(sizes)])[at + np.arange(docs + 1)]
            yield first, self.ids[ranges(places, sizes)], np.diff(bound)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.ones(max(n, 2 * len(x)) - len(x), x.dtype)])


# The steps of tokenizers that may be encoded word by word.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class TextEncoder:
    """Encodes whole texts by all steps of any tokenizer."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id
        self.vocabulary = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)

    def encode(self, texts: pa.Array):
        """As ``WordEncoder.encode``."""
        for first, data, offsets in slices(texts, _SLICE):
            raw = data.tobytes()
            coded = self.tokenizer.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(offsets.tolist())], add_special_tokens=False)
            sizes = np.array([len(e.ids) + 1 for e in coded], np.int64)
            yield first, np.fromiter(itertools.chain.from_iterable([*e.ids, self.end_id] for e in coded), np.uint32, int(sizes.sum())), sizes


@cache
def encoder(path: str, end_id: int) -> WordEncoder | TextEncoder:
    """The word-wise encoder for tokenizers whose steps allow it, else one that runs all steps on whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    steps = json.loads(tokenizer.to_str())
    marks = all(t["content"].startswith("<|") and not t["normalized"] for t in steps["added_tokens"])
    plain = steps["model"]["type"] == "BPE" and all(steps[k] == v for k, v in WORDWISE.items())
    return (WordEncoder if marks and plain else TextEncoder)(tokenizer, end_id)


def re_pair(ids: np.ndarray, lengths: np.ndarray, vocabulary: int, least: int = LEAST_COUNT):
    """Replace frequent pairs by nonterminals until none is frequent or the symbols are used up.

    Symbols are those of 16 bits, or, for a vocabulary of as many, ``RULES`` more than the vocabulary. A
    round counts all pairs, takes those with at least a share 1 / ``SPREAD`` of the greatest count, and
    replaces them from left to right without overlap; a pair replaced fewer than ``least`` times
    is left alone, and a round that shortens the sequence by less than 1 in 1024 is
    the last. Gives the sequence, the symbols of each text, and the rules.
    """
    kind, half, symbols = (np.uint32, 16, 1 << 16) if vocabulary < 1 << 16 else (np.uint64, 32, vocabulary + RULES)
    never = kind((1 << 2 * half) - 1)  # no pair: the last symbol is never paired with itself
    spread, down = (kind(2654435761), kind(12)) if half == 16 else (kind(0x9E3779B97F4A7C15), kind(44))
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    free = vocabulary
    table = np.zeros(1 << 20, np.uint16)
    while free < symbols and len(seq) > 1:
        code = (seq[:-1].astype(kind) << kind(half)) | seq[1:]
        code[last[:-1]] = never
        order = np.sort(code)
        edge = np.flatnonzero(order[1:] != order[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(order)]])
        count = np.diff(edge)
        if order[-1] == never:
            count[-1] = 0
        top = int(count.max(initial=0))
        if top < least:
            break
        some = np.flatnonzero(count >= max(least, top // SPREAD))
        some = some[np.argsort(-count[some], kind="stable")][: min(symbols - free, 1 << 15)]
        pairs = order[edge[some]]
        # the most frequent pair is written last, so it wins a shared slot; others wait for a later round
        slot = (pairs * spread) >> down
        table[slot[::-1]] = np.arange(len(pairs), 0, -1).astype(np.uint16)
        rule = table[(code * spread) >> down]
        table[slot] = 0
        where = np.flatnonzero(rule)
        rule = rule[where].astype(np.int64) - 1
        same = pairs[rule] == code[where]
        where, rule = where[same], rule[same]
        # of a run of overlapping pairs every other one is replaced
        fresh = np.concatenate([[True], where[1:] != where[:-1] + 1])[: len(where)]
        begun = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))]
        odd = ((where - begun) & 1) == 0
        where, rule = where[odd], rule[odd]
        used = np.bincount(rule, minlength=len(pairs))
        good = used >= least
        if not good.any():
            break
        name = np.cumsum(good) - 1 + free
        here = good[rule]
        where, rule = where[here], rule[here]
        seq[where] = name[rule]
        last[where] = last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(pairs[good])
        free += int(good.sum())
        if len(where) < len(seq) // 1024:
            break
    pairs = np.concatenate(rules) if rules else np.zeros(0, kind)
    rules_out = np.stack([pairs >> kind(half), pairs & kind((1 << half) - 1)], 1).astype(np.uint32)
    sizes = np.zeros(len(lengths), np.int64)
    ends = np.flatnonzero(last) + 1
    sizes[lengths > 0] = np.diff(ends, prepend=0)
    return seq, sizes, rules_out


def expanded_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - vocabulary] if a >= vocabulary else 1) + (out[b - vocabulary] if b >= vocabulary else 1)
    return out


def write_shard(doc_ids: list, ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> bytes:
    """One shard's blob."""
    seq, sizes, rules = re_pair(ids, lengths, vocabulary)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    head = np.array([vocabulary, len(lengths), len(rules), len(seq), len(ids), width, STEP, 0], np.uint64)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    expanded = expanded_lengths(rules, vocabulary)
    size = np.ones(len(seq), np.int64)
    size[seq >= vocabulary] = expanded[seq[seq >= vocabulary].astype(np.int64) - vocabulary]
    sums = (np.cumsum(size) - size)[::STEP]
    parts = [head, rules.astype(np.uint32), expanded.astype(np.uint32), seq.astype(np.uint16 if width == 2 else np.uint32), sums.astype(np.uint64)]
    parts += [np.array([i or 0 for i in doc_ids], np.int64), known, np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)]
    return b"RPR2" + b"".join(p.tobytes() for p in parts)


class Shard:
    """A blob's arrays, read in place."""

    def __init__(self, blob):
        if bytes(blob[:4]) != b"RPR2":
            raise ValueError("not a token shard")
        head = np.frombuffer(blob, np.uint64, 8, 4).astype(int)
        self.vocabulary, docs, rules, symbols, self.size, width, self.step = map(int, head[:7])
        at = _HEAD

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(np.uint32, 2 * rules).reshape(-1, 2)
        self.lengths = take(np.uint32, rules).astype(np.int64)
        self.symbols = take(np.uint16 if width == 2 else np.uint32, symbols)
        self.sums = take(np.uint64, -(-symbols // self.step)).astype(np.int64)
        self.doc_ids = take(np.int64, docs)
        self.valid = take(np.uint8, docs).astype(bool)
        self.first, self.at = take(np.uint64, docs + 1).astype(np.int64), take(np.uint64, docs + 1).astype(np.int64)

    @property
    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All nonterminals' ids, one after the other, and where each starts."""
        if not hasattr(self, "_expansions"):
            starts = np.concatenate([[0], np.cumsum(self.lengths)])
            flat, v = np.zeros(int(starts[-1]), np.uint32), self.vocabulary
            where = starts.tolist()
            for i, (a, b) in enumerate(self.rules.tolist()):
                k = where[i]
                for s in (a, b):
                    if s < v:
                        flat[k] = s
                        k += 1
                    else:
                        x, y = where[s - v], where[s - v + 1]
                        flat[k : k + y - x] = flat[x:y]
                        k += y - x
            self._expansions = flat, starts
        return self._expansions

    def all(self) -> np.ndarray:
        """The ids of the whole shard, every nonterminal expanded once."""
        symbols = self.symbols.astype(np.int64)
        flat, starts = self.expansions
        pool = np.concatenate([np.arange(self.vocabulary, dtype=np.uint32), flat])
        rule = symbols >= self.vocabulary
        place, size = symbols.copy(), np.ones(len(symbols), np.int64)
        place[rule] = self.vocabulary + starts[symbols[rule] - self.vocabulary]
        size[rule] = self.lengths[symbols[rule] - self.vocabulary]
        return pool[ranges(place, size)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that some symbols stand for: nonterminals give way to their pairs until none is left."""
        out = symbols.astype(np.int64)
        while (rule := out >= self.vocabulary).any():
            size = 1 + rule.astype(np.int64)
            at = np.cumsum(size) - size
            new = np.empty(int(size.sum()), np.int64)
            new[at] = out
            new[at[rule]], new[at[rule] + 1] = self.rules[out[rule] - self.vocabulary].T
            out = new
        return out.astype(np.uint32)

    def doc(self, i: int) -> np.ndarray:
        """The ids of the i-th text."""
        return self.expand(self.symbols[self.first[i] : self.first[i + 1]])

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b of the whole shard: the stored sums lead to the symbols there, the lengths to the first of them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        near = int(np.searchsorted(self.sums, a, "right")) - 1
        symbols = self.symbols[near * self.step : int(np.searchsorted(self.sums, b, "left")) * self.step].astype(np.int64)
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.vocabulary
        size[rule] = self.lengths[symbols[rule] - self.vocabulary]
        ends = int(self.sums[near]) + np.cumsum(size)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        skip = a - (int(ends[i - 1]) if i else int(self.sums[near]))
        return self.expand(symbols[i:j])[skip : skip + b - a]


_SHARDS = "first_doc long, seq long, n_docs long, n_tokens long, blob binary"


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text of ``docs`` and write the shards to ``path`` in ascending order of doc_id."""

    def run(batches):
        coder = encoder(tokenizer, end_id)
        seq = itertools.count()
        held_docs: list = []
        held_ids: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []
        held = 0

        def shard():
            nonlocal held
            blob = write_shard(held_docs, np.concatenate(held_ids), np.concatenate(held_sizes), coder.vocabulary)
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((held_docs[0], pa.int64()), (next(seq), pa.int64()), (len(held_docs), pa.int64()), (held, pa.int64()), (blob, pa.binary()))], names=["first_doc", "seq", "n_docs", "n_tokens", "blob"])
            held_docs.clear(), held_ids.clear(), held_sizes.clear()
            held = 0
            return out

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, ids, sizes in coder.encode(batch.column("text")):
                ends = np.concatenate([[0], np.cumsum(sizes)])
                i = 0
                while i < len(sizes):
                    # as many whole texts as the shard has room for, one at least
                    j = int(np.searchsorted(ends, ends[i] + shard_ids - held, "right")) - 1
                    if j <= i and held:
                        yield shard()
                        continue
                    j = max(j, i + 1)
                    part = ids[ends[i] : ends[j]]
                    held_docs += names[first + i : first + j]
                    held_ids.append(part.astype(np.uint16) if coder.vocabulary < 1 << 16 else part)
                    held_sizes.append(sizes[i:j])
                    held += len(part)
                    i = j
        if held:
            yield shard()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.mapInArrow(run, _SHARDS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _based(shards: DataFrame) -> DataFrame:
    """Blobs with the number of ids in all shards before, summed within ranges of the order and over the ranges."""
    key = [F.asc_nulls_first("first_doc"), F.asc("seq")]
    counts = stored(shards.select("first_doc", "seq", "n_tokens").repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "shard-counts")
    before = lambda window: F.coalesce(F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))  # a row for each range
    base = counts.withColumn("within", before(Window.partitionBy("part").orderBy(*key))).join(F.broadcast(parts), "part")
    base = base.select("first_doc", "seq", (F.col("first") + F.col("within")).alias("base"))
    same = [shards["first_doc"].eqNullSafe(base["first_doc"]), shards["seq"] == base["seq"]]
    return shards.join(base, same).select("blob", "base")


def _decoded(shards: DataFrame, column: str, kind: str, make) -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``make`` gives for the ids of consecutive texts and their bounds."""

    def run(batches):
        for batch in batches:
            for blob, base in zip(batch.column("blob"), batch.column("base"), strict=True):
                s = Shard(blob.as_buffer())
                ids, at = s.all().astype("<u4"), s.at
                for i in range(0, len(at) - 1, 4096):
                    j = min(i + 4096, len(at) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[i:j], mask=~s.valid[i:j]), pa.array(at[i:j] + base.as_py()), pa.array(np.diff(at[i : j + 1])), make(ids[at[i] : at[j]], at[i : j + 1] - at[i])], names=["doc_id", "start", "n_tokens", column])

    return _based(shards).mapInArrow(run, f"doc_id long, start long, n_tokens long, {column} {kind}")


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every text of a store, decoded from its blobs."""
    return _decoded(shards, "ids", "binary", lambda ids, at: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)]))


def digests(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every text of a store, decoded from its blobs."""
    return _decoded(shards, "ids_crc32", "long", lambda ids, at: pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()))


def token_store(docs: DataFrame, tokenizer: str, path: str | None = None, **kw) -> DataFrame:
    """Write a store (by default in the shared folder) and read its shards back."""
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_store(docs, path, tokenizer, **kw)
    return spark.read.schema(_SHARDS).parquet(path)

"""Alignment of the tokens that two tokenizers make of the same texts.

The first tokenizer is byte-level BPE (a ``tokenizers`` file) and encodes a space and the text, the second is a
``sentencepiece`` model that adds the space itself. Tokens are byte intervals of that string. Those of the second are a
static index, sorted by start and by end; two bisections for each token of the first list the ones that it overlaps. A gap
between tokens of the second that no token of the first spans is a group boundary. Links are all pairs within a group.

Both tokenizers begin a token at a space after a character that is no white space (the first by its pattern, the second as
none of its pieces holds a space after another character, which is checked). Texts are cut there, every cut piece is
encoded and aligned once for as long as the worker's bounded memo holds it, and groups never cross a cut.

A pair's count is the number of rows whose text links it. Each shard of whole texts (``SHARD_BYTES`` together, or one longer)
keeps its texts as numbers of pieces, and its pairs with their counts. The summed table of pairs goes to the shards as a
broadcast of at most ``BROADCAST_PAIRS`` rows, and else by a join with the pairs of each shard.

Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and an empty ``groups_sha256``. Repeated rows
count each, null ids stay, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .words import ranges, slices

SHARD_BYTES, SHARD_ROWS, MEMO_PIECES, LEARN_PIECES, BROADCAST_PAIRS = 4 << 20, 1 << 14, 500_000, 1 << 14, 2_000_000
_SPACE = "▁"
_SPACES = np.zeros(256, bool)
_SPACES[[*range(9, 14), *range(28, 33)]] = True
# Last bytes of the white space characters of two and three bytes, by the bytes before.
_WIDE_SPACES = {(0xC2,): [0x85, 0xA0], (0xE1, 0x9A): [0x80], (0xE2, 0x80): [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF], (0xE2, 0x81): [0x9F], (0xE3, 0x80): [0x80]}
#: How byte-level tokenizers write the bytes that are not printable Latin-1: as code points from 256 on.
_BYTE_OF = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
_BYTE_OF |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class ByteLevel:
    """A byte-level BPE of the ``tokenizers`` library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        steps = json.loads(self.tokenizer.to_str())
        if steps["normalizer"] or (steps["pre_tokenizer"] or {}).get("type") != "ByteLevel" or steps["pre_tokenizer"].get("add_prefix_space") or not steps["pre_tokenizer"].get("use_regex"):
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(_BYTE_OF.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """A ``sentencepiece`` BPE that puts a space before each text and none of whose pieces holds a space after another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.vocab_size())]
        self.space = m.piece_to_id(_SPACE)
        if m.is_unknown(self.space) or any(_SPACE in n.lstrip(_SPACE) for n in names):
            raise ValueError(f"{path} has pieces that cross words")
        self.bytes = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Of pieces that begin with the space that the model adds."""
        coded = self.model.encode([p[1:] for p in pieces], num_threads=1)
        return [ids if len(p) > 1 else [self.space] for p, ids in zip(pieces, coded, strict=True)]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of two tilings of the same bytes, by their ends.

    The ends of B are the index. A bisection by start and one by end stab it for each token of A.
    """
    a_starts, b_starts = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left") - 1
    spans = np.zeros(len(b_ends) + 1, np.int64)  # how many tokens of A span the gap before each token of B
    np.add.at(spans, first + 1, 1)
    np.add.at(spans, last + 1, -1)
    group = np.cumsum(np.cumsum(spans)[:-1] == 0) - 1
    return group[first] if len(first) else first, group


def sorted_unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


class _Strings:
    """Byte strings one after the other, to be put together by number."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[numbers], self.size[numbers])]


class Memo:
    """Pieces met before, by number: sizes, groups in writing, and the linked pairs with how often they occur."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.wide = len(second.bytes)
        self.a_bytes, self.b_bytes = _Strings(first.bytes), _Strings(second.bytes)
        # a token's number and the sign after it
        most = max(len(first.bytes), self.wide)
        self.digits = _Strings([f"{i}{sign}".encode() for sign in ",|;" for i in range(most)])
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.written: list[bytes] = []
        self.sizes, self.pairs = [np.zeros((0, 5), np.int64)], [np.zeros((0, 2), np.int64)]

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of distinct pieces."""
        if len(self.known) + len(pieces) > MEMO_PIECES:
            self.clear()
        new = [p for p in pieces if p not in self.known]
        for i in range(0, len(new), LEARN_PIECES):
            self._learn(new[i : i + LEARN_PIECES])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of (tokens of A, of B, groups, links, pairs; A is 0 for a changed piece), and of (pair, times)."""
        self.sizes, self.pairs = [np.concatenate(self.sizes)], [np.concatenate(self.pairs)]
        return self.sizes[0], self.pairs[0]

    @staticmethod
    def _flat(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        return n, np.fromiter(chain.from_iterable(coded), np.int64, int(n.sum()))

    def _same(self, pieces: list[bytes], strings: _Strings, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the tokens of each piece spell it."""
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        of = np.repeat(np.arange(len(pieces)), n)
        good = np.bincount(of, strings.size[ids], len(pieces)).astype(np.int64) == size
        ids = ids[good[of]]
        at = np.flatnonzero(good)
        part = data[ranges((np.cumsum(size) - size)[at], size[at])]
        other = strings.joined(ids) != part
        good[np.repeat(at, size[at])[other]] = False
        return good

    def _learn(self, new: list[bytes]) -> None:
        texts = [p.decode() for p in new]
        na, a = self._flat(self.first.encode(texts))
        nb, b = self._flat(self.second.encode(texts))
        good = self._same(new, self.a_bytes, na, a) & self._same(new, self.b_bytes, nb, b)
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = na * good, nb * good
        ga, gb = overlaps(np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b]))
        groups = int(gb[-1]) + 1 if len(gb) else 0
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        piece_b = np.repeat(np.arange(len(new)), nb)
        at_b = np.cumsum(in_b) - in_b
        n_groups = np.bincount(piece_b[at_b], minlength=len(new)) if groups else np.zeros(len(new), np.int64)
        # groups in writing: tokens of A, the last with a bar, then those of B, the last with a semicolon
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[np.cumsum(in_a) - 1], last_b[np.cumsum(in_b) - 1] = True, True
        place = np.concatenate([np.arange(len(a)) + at_b[ga], np.arange(len(b)) + np.cumsum(in_a)[gb]]) if groups else a
        number = np.empty(len(a) + len(b), np.int64)
        number[place] = np.concatenate([a + last_a * self.most, b + last_b * 2 * self.most])
        text = self.digits.joined(number).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.digits.size[number])])[np.concatenate([[0], np.cumsum(na + nb)])].tolist()
        # links: each token of A with the tokens of B in its group
        times = in_b[ga] if groups else ga
        link = np.repeat(a, times) * self.wide + b[ranges(at_b[ga], times)] if groups else a
        piece = np.repeat(np.repeat(np.arange(len(new)), na), times)
        size = len(self.first.bytes) * self.wide
        pair, often = sorted_unique(piece * size + link)
        sizes = np.stack([na, nb, n_groups, np.bincount(piece, minlength=len(new)), np.bincount(pair // size, minlength=len(new))], 1)
        self.known |= {p: len(self.written) + i for i, p in enumerate(new)}
        self.written += [text[i : max(i, j - 1)] for i, j in pairwise(ends)]
        self.sizes.append(sizes)
        self.pairs.append(np.stack([pair % size, often], 1))


@cache
def memo(first: str, second: str) -> Memo:
    return Memo(ByteLevel(first), Pieces(second))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts, each text after a space, and the number of pieces of each."""
    data = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(len(offsets))
    before = np.concatenate([np.zeros(3, np.uint8), data])
    one, two, three = before[2:-1], before[1:-2], before[:-3]
    space = _SPACES[one]
    for lead, last in _WIDE_SPACES.items():
        space |= (two == lead[-1]) & np.isin(one, last) & ((three == lead[0]) | (len(lead) == 1))
    start = (data == 32) & ~space
    start[offsets[:-1]] = True
    at = np.flatnonzero(start)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)])
    return pieces, np.diff(np.searchsorted(at, offsets))


def _planes(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1).astype(np.int64)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_SHARD = "shard string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pieces array<long>, codes binary, piece_pairs binary, n_pieces long, pair_at binary, pair_times binary, n_pair_at long, pairs array<long>, pair_docs array<long>"


def aligned_shards(docs: DataFrame, first: str, second: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of whole texts: counts and digests of each text, its pieces by number, the pairs of each piece, and how many texts link each pair."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("shard", pa.string()), ("doc_id", longs), *((c, longs) for c in _COUNTS), ("groups_sha256", pa.list_(pa.string())), ("pieces", longs), ("codes", pa.binary()), ("piece_pairs", pa.binary()), ("n_pieces", pa.int64()), ("pair_at", pa.binary()), ("pair_times", pa.binary()), ("n_pair_at", pa.int64()), ("pairs", longs), ("pair_docs", longs)])

    def run(batches):
        known = memo(first, second)
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in slices(batch.column("text"), shard_bytes, SHARD_ROWS):
                yield pa.RecordBatch.from_pylist([_shard(known, data, offsets) | {"doc_id": ids.slice(row, len(offsets) - 1).to_pylist()}], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, _SHARD)


def _shard(known: Memo, data: np.ndarray, offsets: np.ndarray) -> dict:
    pieces, count = cut(data, offsets)
    coded = pieces.dictionary_encode()
    entry = known.numbers(coded.dictionary.to_pylist())
    sizes, pairs = known.table()
    pair_end = np.cumsum(sizes[:, 4])
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    changed = np.bincount(doc, sizes[entry[code], 0] == 0, len(count)) > 0
    empty = changed | (np.diff(offsets) == 0)
    code, doc = code[~empty[doc]], doc[~empty[doc]]
    count = np.where(empty, 0, count)
    some = np.zeros(len(entry), bool)
    some[code] = True
    used, code = np.flatnonzero(some), (np.cumsum(some) - 1)[code]
    entry = entry[used]
    n_pairs = sizes[entry, 4]
    own = pairs[ranges(pair_end[entry] - n_pairs, n_pairs)]
    distinct, _ = sorted_unique(own[:, 0])
    at = np.searchsorted(distinct, own[:, 0])
    # texts that link each pair: distinct pieces of a text, then distinct pairs
    once, _ = sorted_unique(doc * max(1, len(used)) + code)
    d, c = np.divmod(once, max(1, len(used)))
    ends = np.cumsum(n_pairs)
    linked, _ = sorted_unique(np.repeat(d, n_pairs[c]) * max(1, len(distinct)) + at[ranges(ends[c] - n_pairs[c], n_pairs[c])])
    texts, end = [known.written[e] for e in entry.tolist()], np.concatenate([[0], np.cumsum(count)]).tolist()
    names = list(map(texts.__getitem__, code.tolist()))
    sums = {n: np.bincount(doc, sizes[entry[code], i], len(count)).astype(np.int64).tolist() for i, n in enumerate(_COUNTS)}
    digests = [hashlib.sha256(b";".join(names[i:j])).hexdigest() if j > i else "" for i, j in pairwise(end)]
    return {
        "shard": uuid.uuid4().hex, **sums, "groups_sha256": digests, "pieces": count.tolist(), "codes": _planes(code), "piece_pairs": _planes(n_pairs), "n_pieces": len(used), "pair_at": _planes(at),
        "pair_times": _planes(own[:, 1]), "n_pair_at": len(at), "pairs": distinct.tolist(), "pair_docs": np.bincount(linked % max(1, len(distinct)), minlength=len(distinct)).tolist(),
    }


def _rows(shard: dict, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The texts of a shard, given the corpus-wide counts of its pairs and which are the best of their token."""
    sizes, n_pairs = np.array(shard["pieces"], np.int64), _numbers(shard["piece_pairs"], shard["n_pieces"])
    code, at, times = _numbers(shard["codes"], int(sizes.sum())), _numbers(shard["pair_at"], shard["n_pair_at"]), _numbers(shard["pair_times"], shard["n_pair_at"])
    ends, edges = np.concatenate([[0], np.cumsum(n_pairs)]), np.concatenate([[0], np.cumsum(sizes)])

    def sums(of_pair: np.ndarray) -> np.ndarray:
        piece = np.diff(np.concatenate([[0], np.cumsum(of_pair[at] * times)])[ends])
        return np.diff(np.concatenate([[0], np.cumsum(piece[code])])[edges])

    columns = {"doc_id": pa.array(shard["doc_id"], pa.int64()), **{c: pa.array(shard[c], pa.int64()) for c in _COUNTS}, "n_best": pa.array(sums(best.astype(np.int64))), "count_sum": pa.array(sums(count)), "groups_sha256": pa.array(shard["groups_sha256"], pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pair_counts(shards: DataFrame, wide: int) -> DataFrame:
    """``pair, n, best``: number of rows that link each pair, and whether no pair of the same first token has more."""
    counts = shards.select(F.inline(F.arrays_zip("pairs", "pair_docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_docs").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair div {wide}"))))


def align(docs: DataFrame, first: str, second: str, shard_bytes: int = SHARD_BYTES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``doc_id, text``.

    ``first`` and ``second`` are paths that every executor can read.
    """
    spark = docs.sparkSession
    shards = stored(aligned_shards(docs, first, second, shard_bytes), "aligned")
    counts = stored(pair_counts(shards, len(memo(first, second).second.bytes)), "pairs")
    if counts.count() <= broadcast_pairs:
        table = counts.toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))

        def run(batches):
            pair, n, best = held.value
            for batch in batches:
                for shard in batch.to_pylist():
                    at = np.searchsorted(pair, np.array(shard["pairs"], np.int64))
                    yield _rows(shard, n[at], best[at])

        return shards.mapInArrow(run, _OUT)
    asked = shards.select(F.col("shard").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(counts, "pair").select("of", "place", "n", "best")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["place"].to_numpy())
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order]
        return pa.Table.from_batches([_rows(shard, n, best) for shard in left.to_pylist()])

    return shards.groupBy("shard").cogroup(found.groupBy("of")).applyInArrow(meet, _OUT)

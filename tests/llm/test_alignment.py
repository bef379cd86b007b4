import collections
import hashlib
import random

import pytest

from sparkloom.llm import alignment

from .helpers import DOCS, docs

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def tokens(texts):
    """For each text the (id, bytes) of both tokenizers, run over the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {c: i for c, i in alignment._BYTE_OF.items()}
    for text in texts:
        if not text:
            yield None
            continue
        one = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        yield (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else None


def ends(side):
    out, at = [], 0
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def plain(texts):
    groups = []
    for pair in tokens(texts):
        found = []
        if pair:
            both = set(ends(pair[0])) & set(ends(pair[1]))
            for end in sorted(both):
                start = found[-1][2] if found else 0
                found.append(([i for (i, _), e in zip(pair[0], ends(pair[0])) if start < e <= end], [i for (i, _), e in zip(pair[1], ends(pair[1])) if start < e <= end], end))
        groups.append(found)
    count, best = collections.Counter(), collections.Counter()
    for found in groups:
        count.update({(a, b) for x, y, _ in found for a in x for b in y})
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for found in groups:
        links = [(a, b) for x, y, _ in found for a in x for b in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in found)
        out.append((sum(len(x) for x, _, _ in found), sum(len(y) for _, y, _ in found), len(found), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    letters = "aaabcdeéßüñ 日本語ไทย　\xa0  \x85 \x1c\t\n  .,'!?-_019😀▁<>|ſ́\x00"
    words = ["the", "don't", "</s>", "<s>", "<|endoftext|>", "<0x41>", "token", " ", "  ", "1234", "naïve", "”", "…"]
    return ["".join(rng.choice([rng.choice(words), rng.choice(letters), " " + rng.choice(words)]) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize(("shard", "pairs"), [(4 << 20, 2_000_000), (500, 2_000_000), (700, 5)])
def test_whole_texts(spark, shard, pairs):
    made = [*texts(1, 150), None, "", " ", "  ", "x ", "a▁b", "word " * 3000, "日" * 5000, "x", "x"]
    rows = [*enumerate(made), (None, "null id"), (3, made[3])]
    got = alignment.align(docs(spark, rows).repartition(3), A, B, shard, pairs).collect()
    want = collections.Counter(zip([r[0] for r in rows], plain([r[1] for r in rows])))
    assert collections.Counter((r.doc_id, tuple(r)[1:]) for r in got) == want
    assert sum(w[1][0] == 0 for w in want) > 3


def test_forgotten_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(alignment, "MEMO_PIECES", 50)
    memo = alignment.Memo(alignment.ByteLevel(A), alignment.Pieces(B))
    made = [t for t in texts(2, 60) if t]
    want = plain(made)
    for text, row in zip(made, want, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        shard = alignment._shard(memo, data, np.array([0, len(data)]))
        assert (shard["n_a"][0], shard["n_b"][0], shard["n_groups"][0], shard["n_links"][0], shard["groups_sha256"][0]) == (*row[:4], row[6])


def test_groups_of_two_tilings():
    import numpy as np

    a, b = alignment.overlaps(np.array([2, 3, 7, 9]), np.array([1, 3, 4, 7, 8, 9]))
    assert a.tolist() == [0, 0, 1, 2]
    assert b.tolist() == [0, 0, 1, 1, 2, 2]


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).collect() == []

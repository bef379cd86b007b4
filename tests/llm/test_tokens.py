import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import token_store as T

from .helpers import docs

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def plain(texts):
    from tokenizers import Tokenizer

    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch(list(texts), add_special_tokens=False)]


def test_word_encoder_equals_the_tokenizer():
    random.seed(4)
    letters = "abcXYZéÉßüÜñÑìİıſKΣςσ.,'s're|<>!?-_0123 \n\t\x0b\x1c\x85\xa0　́ﬁªºµ中文ไทย"
    encoder = T.encoder(PATH, 2)
    assert isinstance(encoder, T.WordEncoder)
    for _ in range(60):
        texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(30)] + ["a<|endoftext|>. b", "<|ENDOFTEXT|>", "it's.x ,. a., 3., é. É,"]
        ids, sizes = (np.concatenate(x) for x in zip(*((o[1], o[2]) for o in encoder.encode(pa.array(texts))), strict=True))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain(texts)


def test_re_pair_round_trip_and_random_access():
    random.seed(5)
    phrase = [random.randrange(49_000) for _ in range(40)]
    parts = [phrase[random.randrange(20) :][: random.randrange(20)] * random.randrange(5) + [2] for _ in range(800)] + [[7] * 999 + [2], [2]]
    ids, sizes = np.concatenate(parts).astype(np.uint16), np.array([len(p) for p in parts])
    blob = T.write_shard([None, *range(1, len(parts))], ids, sizes, 49_408)
    s = T.Shard(blob)
    assert len(s.rules) > 10 and len(s.symbols) < len(ids) / 3
    assert (s.expand(s.symbols) == ids).all() and (s.all() == ids).all() and s.lengths.max() > 2
    for i in (0, 1, 500, len(parts) - 1):
        assert s.doc(i).tolist() == list(parts[i])
    for _ in range(30):
        a = random.randrange(len(ids))
        b = random.randrange(a, len(ids) + 1)
        assert s.between(a, b).tolist() == ids[a:b].tolist()


def test_store_in_ascending_order(spark):
    rows = [(3, "Hello, world. It's"), (1, None), (2, ""), (9, "x " * 5000), (None, "null id"), (2, "again"), (2, "again"), (5, "Élan vital 12.5")]
    shards = T.token_store(docs(spark, rows), PATH, shard_ids=64)
    assert shards.count() > 1
    out = sorted(T.digests(shards).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in out] == [r[0] for r in ordered]
    at = 0
    for r, ids in zip(out, plain([r[1] or "" for r in ordered]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {bytes(r.ids)[-4:] for r in T.read_documents(shards).collect()} == {np.array([2], "<u4").tobytes()}
    assert T.digests(T.token_store(docs(spark, []), PATH)).count() == 0


def test_any_vocabulary_has_a_grammar():
    random.seed(6)
    phrase = [random.randrange(250_000) for _ in range(30)]
    parts = [phrase[random.randrange(9) :][: random.randrange(20)] * random.randrange(5) + [2] for _ in range(3000)]
    ids, sizes = np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts])
    s = T.Shard(T.write_shard(list(range(len(parts))), ids, sizes, 250_000))
    assert len(s.rules) > 10 and len(s.symbols) < len(ids) / 3 and (s.all() == ids).all()
    assert s.doc(77).tolist() == list(parts[77]) and s.between(5, len(ids) - 5).tolist() == ids[5:-5].tolist()


def test_other_tokenizers_run_all_their_steps(spark):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    assert isinstance(T.encoder(path, 2), T.TextEncoder)
    rows = [(1, "Hello  World\n"), (2, None), (3, "Éa 中文"), (4, "")]
    found = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in T.read_documents(T.token_store(docs(spark, rows), path)).collect()}
    want = Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    assert found == {r[0]: [*e.ids, 2] for r, e in zip(rows, want, strict=True)}

import random

import numpy as np
import pytest

from sparkloom.llm import decontaminate as D

from .helpers import docs, words


def plain_tiles(text, item, least):
    """Greedy string tiling by direct comparison."""
    least = max(1, min(least, len(item)))
    ft, fi, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best, found = 0, []
        for a in range(len(text)):
            for b in range(len(item)):
                k = 0
                while a + k < len(text) and b + k < len(item) and ft[a + k] and fi[b + k] and text[a + k] == item[b + k]:
                    k += 1
                if k > best:
                    best, found = k, [(a, b)]
                elif k == best and k:
                    found.append((a, b))
        if best < least:
            return tiles
        for a, b in found:
            if all(ft[a : a + best]) and all(fi[b : b + best]):
                tiles.append((a, b, best))
                ft[a : a + best] = fi[b : b + best] = [False] * best


def test_tiles_match_a_plain_version():
    random.seed(6)
    for _ in range(150):
        text = [random.randrange(6) for _ in range(random.randrange(40))]
        item = [random.randrange(6) for _ in range(random.randrange(1, 25))]
        got = D.tile(np.array(text, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array(item, np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
        want = plain_tiles(text, item, 3)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        for a, b, n in got:
            assert text[a : a + n] == item[b : b + n]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_leaks_by_lookup_and_by_join(spark, bound):
    random.seed(7)
    item = [f"q{i}" for i in range(40)]
    swapped = item[20:] + ["z"] + item[:20]
    noise = [f"n{random.randrange(99)}" for _ in range(300)]
    rows = [
        (1, " ".join(noise[:90] + item + noise[90:])), (2, " ".join(swapped).upper()), (3, " ".join(item[:15] + noise)), (4, " ".join(noise)),
        (5, None), (6, ""), (7, "short one"), (8, "a short one here"), (None, " ".join(item)), (1, " ".join(item[:30])), (9, " ".join(item)), (9, " ".join(item)),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short one"), (3, None), (4, ""), (2, "short one")], "item_id long, text string")
    out = D.leaks(docs(spark, rows), bench, broadcast_words=bound).collect()
    want = {(1, 1), (2, 1), (7, 2), (8, 2), (None, 1), (9, 1)}
    assert {(r.doc_id, r.item_id) for r in out} == want
    assert sum(r.item_id == 2 and r.doc_id == 7 for r in out) == 2  # repeated items are judged each
    assert {r.coverage for r in out if r.doc_id == 2} == {1.0} and {r.tiles for r in out if r.doc_id == 2} == {2}
    kept = D.without_leaks(docs(spark, rows), bench, broadcast_words=bound).collect()
    assert sorted((r.doc_id, len(words(r.text))) for r in kept) == [(3, 315), (4, 300), (5, 0), (6, 0)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.leaks(docs(spark, []), bench).count() == 0
    assert D.leaks(docs(spark, [(1, "a b c d e f")]), bench.limit(0)).count() == 0


def test_no_leak_is_lost_to_common_seeds(spark):
    """Items that share phrases, texts that hold only these: every pair against the plain coverage."""
    random.seed(11)
    phrase = [[f"p{k}_{i}" for i in range(6)] for k in range(4)]
    pool = lambda: sum((random.choice(phrase) if random.random() < 0.6 else [f"u{random.randrange(60)}" for _ in range(4)] for _ in range(random.randrange(1, 7))), [])
    items, rows = [(i, " ".join(pool())) for i in range(30)], [(i, " ".join(pool() + pool())) for i in range(60)]
    want = {(d, i) for d, t in rows for i, x in items if sum(n for *_, n in plain_tiles(t.split(), x.split(), 5)) >= 0.5 * len(x.split())}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs(spark, rows), bench, broadcast_words=bound).collect()} == want

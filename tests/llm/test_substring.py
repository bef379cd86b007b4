import hashlib
import random

import pytest

from sparkloom.llm import substring_dedup

from .helpers import docs, repeated


def check(spark, rows, window, seed):
    out = substring_dedup.remove_repeats(docs(spark, rows), window, seed).collect()
    lists, masks = repeated([r[1] for r in rows], window)
    want = sorted((str(r[0]), len(w), sum(m), " ".join(x for x, y in zip(w, m, strict=True) if not y)) for r, w, m in zip(rows, lists, masks, strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in out) == want


@pytest.mark.parametrize("window,seed", [(35, 12), (6, 2)])
def test_matches_brute_force(spark, window, seed):
    random.seed(window)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = [random.choice(base) for _ in range(random.randrange(0, 200))]
        if i % 3:
            a = random.randrange(300)
            text[10:10] = base[a : a + random.randrange(window - 3, 3 * window)]
        rows.append((i, " ".join(text)))
    rows += [(100, "x " * 500), (101, "a b c " * 30), (102, rows[5][1]), (102, rows[5][1]), (103, None), (104, ""), (None, rows[7][1]), (None, " \t\n"), (105, " ".join(base) + "\n" + " ".join(base)), (106, " ".join(base[:window])), (5, rows[9][1])]
    check(spark, rows, window, seed)


def test_long_text_and_nothing(spark):
    random.seed(1)
    long = " ".join(str(random.randrange(10**6)) for _ in range(200_000))
    check(spark, [(1, long), (2, long[1000:2000])], 35, 12)
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_spans_carry_their_words(spark):
    same = " ".join(f"v{i}" for i in range(50))
    rows = substring_dedup.repeated_spans(docs(spark, [(1, "one " + same + " two"), (2, same)])).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == [(1, 1, 50), (2, 0, 50)]
    assert {r.sha256 for r in rows} == {hashlib.sha256(same.encode()).hexdigest()}


def test_words_decide(spark):
    # windows that hashes would have taken for repeats of each other
    rows = docs(spark, [(1, "a b c d e"), (2, "a b x d e"), (3, "a b c d e")])
    keys = {r.doc_id: r.row_key for r in substring_dedup.keyed(rows).collect()}
    found = spark.createDataFrame([(k, [(1, 1, 77)]) for k in keys.values()], "row_key long, windows array<struct<start:int,edges:int,head:long>>")
    bad = {r.doc_id: r.bad for r in substring_dedup.verified(rows, found, 3).collect()}
    assert bad[1] is None and bad[3] is None and [tuple(x) for x in bad[2]] == [(1, 1)]


def test_hot_seed_and_repeated_rows(spark):
    same = " ".join(f"h{i}" for i in range(40))
    rows = [(i, f"x{i} {same} y{i} z{i % 3}") for i in range(60)] + [(7, same)] * 50
    out = substring_dedup.repeated_paths(docs(spark, rows), 6, 2, hot=20)
    few = substring_dedup.repeated_paths(docs(spark, rows), 6, 2)
    key = lambda df: sorted(map(tuple, df.select("row_key", "start", "edges", "single").distinct().collect()))
    assert key(out) == key(few)
    check(spark, rows, 6, 2)

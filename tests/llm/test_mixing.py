import hashlib
import math
import random

import pytest

from sparkloom.llm import mixing as M

from .helpers import docs, words


def plain_targets(sizes, weights, total, most):
    left, share, capped = total, {}, set()
    while True:
        rest = {s for s in sizes if s not in capped}
        w = sum(weights[s] for s in rest)
        share = {s: left * weights[s] / w for s in rest}
        over = {s for s in rest if share[s] >= most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in sizes}
        capped |= over
        left -= sum(most * sizes[s] for s in over)
        if capped == set(sizes):
            return {s: most * sizes[s] for s in sizes}


def corpus():
    random.seed(11)
    rows = []
    for i in range(400):
        source = random.choice(["a", "b", "b", "b", "b", "c", "d", None])
        rows.append((i, "w " * random.randrange(60), source))
    rows += [(900, None, "a"), (901, "", "e"), (902, "x " * 3, "f"), (7, "q r", "b"), (8, "same row", "b"), (8, "same row", "b"), (None, "no id", "c")]
    return rows


@pytest.mark.parametrize("bins,sort_rows", [(8, 10), (1024, 100_000)])
def test_mix_matches_a_sorted_loop(spark, bins, sort_rows):
    rows = corpus()
    quality = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(0, 300, 2)], "doc_id long, quality double")
    out = M.mix(docs(spark, rows), quality, bins=bins, sort_rows=sort_rows).collect()
    q = {i: 1.0 + i % 3 for i in range(0, 300, 2)}
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(r[1])) for r in rows if r[2] == s) for s in names}
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    target = plain_targets(size, weight, sum(size.values()), 3)
    want = []
    for s in names:
        epochs = math.floor(target[s] / size[s] + 1e-12) if size[s] else 0
        budget, upto = target[s] - epochs * size[s], 0

        def key(r):
            md5 = hashlib.md5((r[1] or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{md5}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            return -math.log(u) / q.get(r[0], 1.0), r[0] is not None, r[0] or 0, md5

        for r in sorted((r for r in rows if r[2] == s), key=key):
            n = len(words(r[1]))
            times = epochs + (budget > 1e-9 and upto + n / 2 <= budget)
            want.append((str(r[0]), str(s), n, times * n))
            upto += n
    assert sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in out) == sorted(want)
    for s in names:
        assert all(abs(r.target - target[s]) < 1e-6 for r in out if r.source == s)
    assert all(r.taken <= 3 * r.size for r in out)


def test_mixed_repeats_rows(spark):
    df = docs(spark, corpus())
    taken = M.mix(df).agg({"times": "sum"}).first()[0]
    out = M.mixed(df)
    assert out.columns == df.columns and out.count() == taken
    per = {(r.doc_id, r.source): r.n for r in M.mix(df).groupBy("doc_id", "source").agg({"times": "sum"}).withColumnRenamed("sum(times)", "n").collect() if r.n}
    assert per == {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert M.mixed(docs(spark, [])).count() == 0


def test_a_row_repeated_often_beside_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(M, "REPEATS", 7)
    rows = [(1, "one two three", "a")] * 200 + [(i, "w " * (1 + i % 9), "b") for i in range(2, 900)] + [(5000, "", "c")] * 20
    out = M.mix(docs(spark, rows), bins=4, sort_rows=20).collect()
    assert len(out) == len(rows)
    a = [r for r in out if r.source == "a"]
    taken = sum(r.taken for r in a)
    assert abs(taken - a[0].target) <= 1.5 and {r.times for r in a} <= {math.floor(a[0].target / 600), math.floor(a[0].target / 600) + 1}
    b = [r for r in out if r.source == "b"]
    assert abs(sum(r.taken for r in b) - b[0].target) <= 4.5
    # in the order of the keys, what is taken once more comes first
    plain = M.mix(docs(spark, rows), bins=1024, sort_rows=100_000).collect()
    assert sorted((r.doc_id, r.times) for r in out) == sorted((r.doc_id, r.times) for r in plain)

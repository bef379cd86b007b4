import collections
import random
import zlib

from sparkloom.llm import sharding as S

from .helpers import docs


def corpus():
    random.seed(12)
    rows = [(i, "t" * random.randrange(400) + str(random.random()), random.choice("aaaab")) for i in range(3000)]
    rows += [(5000 + i, "the same text over and over", random.choice("xyz")) for i in range(400)]
    return rows + [(9000, None), (9001, ""), (None, "null id"), (7, "é" * 50), (7, "é" * 50)]


def check(rows, out, leaves):
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(d[0]), len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in rows)
    by, weight = collections.defaultdict(list), collections.Counter()
    for r in out:
        assert 0 <= r.shard < leaves
        by[r.shard].append(r.slot)
        weight[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    groups = collections.defaultdict(set)
    for r in out:
        groups[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in groups.values())
    return weight


def test_shards_are_even_and_keep_copies_together(spark):
    rows = corpus()
    out = S.shard(docs(spark, rows), 20).collect()
    weight = check(rows, out, 20)
    heavy = 400 * (27 + 16)
    rest = sorted(w for w in weight.values() if w < heavy)
    mean = sum(weight.values()) / 20
    assert len(weight) == 20 and max(weight.values()) < mean + 600 if heavy < mean else max(rest) - min(rest) < 0.1 * mean
    again = S.shard(docs(spark, rows), 20).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_a_heavy_group_is_alone(spark):
    rows = [(i, "copy" * 10) for i in range(500)] + [(1000 + i, f"text {i}") for i in range(300)]
    weight = check(rows, S.shard(docs(spark, rows), 5).collect(), 5)
    light = sorted(weight.values())[:4]
    assert max(weight.values()) == 500 * 56 and max(light) - min(light) < 200


def test_small_and_empty(spark):
    assert S.shard(docs(spark, []), 4).count() == 0
    check([(1, "a")], S.shard(docs(spark, [(1, "a")]), 40).collect(), 40)
    rows = [(i, f"{i}" * 20) for i in range(64)]
    assert len({r.shard for r in S.shard_to_bytes(docs(spark, rows), 500).collect()}) > 4


def test_cuts_are_weighted_medians_along_the_widest_axis(spark):
    random.seed(5)
    points = [(bytes([i >> 8, i & 255]), random.randrange(1, 40), *(random.random() * w for w in (0.2, 0.9, 0.5, 0.1, 0.7))) for i in range(1200)]
    table = spark.createDataFrame(points, "node binary, w long, x0 double, x1 double, x2 double, x3 double, x4 double")
    shard = {bytes(r.node): r.shard for r in S.tree(table, 6).collect()}
    assert set(shard.values()) == set(range(6))

    def check(some, first, n):
        if n < 2:
            return
        half = n // 2
        left, right = ([p for p in some if (shard[p[0]] < first + half) == side] for side in (True, False))
        axis = max(range(5), key=lambda k: max(p[2 + k] for p in some) - min(p[2 + k] for p in some)) + 2
        assert max(p[axis] for p in left) < min(p[axis] for p in right)
        total = sum(p[1] for p in some)
        assert abs(sum(p[1] for p in left) - total * half / n) <= 40 + 0.001 * total
        check(left, first, half)
        check(right, first + half, n - half)

    check(points, 0, 6)


def test_heavy_groups_go_through_the_cuts(spark):
    random.seed(6)
    rows = [(i, "x" * int(10 ** random.uniform(1, 3.7)) + str(i)) for i in range(400)]  # a few make most of the bytes
    weight = check(rows, S.shard(docs(spark, rows), 16).collect(), 16)
    mean = sum(weight.values()) / 16
    heaviest = max(len(t) + 16 for _, t in rows)
    assert heaviest > mean / 8 and max(weight.values()) < 1.15 * mean and min(weight.values()) > 0.85 * mean

import numpy as np

from sparkloom.llm import vector_dedup as V

from .helpers import components


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x[50:120] = x[50] + 0.2 * rng.standard_normal((70, 16))  # a large cluster, some links just below
    x[200:210] = x[200]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] + [0.0] * 15), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-0.0] * 16), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "vec_id long, embedding array<float>, node string, size string")
    got = V.vector_groups(df, block=16, miss=1e-5).collect()
    ok = [np.array(v, float) if v and None not in v else None for _, v in rows]
    ok = [v / np.linalg.norm(v) if v is not None and np.isfinite(v).all() and np.any(v) else None for v in ok]
    n = len(rows)
    links = [(a, b) for a in range(n) for b in range(a + 1, n) if ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    root = components(links, range(n))
    degree = np.bincount(np.array(links).reshape(-1), minlength=n)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[root[i]] = min(low.get(root[i], 1 << 60), rows[i][0])
    want = sorted((str(rows[i][0]), int(degree[i]), low.get(root[i])) for i in range(n))
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_double_vectors_and_nothing(spark):
    df = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in V.vector_groups(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert V.vector_groups(df.limit(0)).count() == 0

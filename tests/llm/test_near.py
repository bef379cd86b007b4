import itertools
import random

import numpy as np

from sparkloom.llm import near_dedup as N

from .helpers import components, docs, words


def sets(texts):
    lists = [words(t) for t in texts]
    return [({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}) if w else set() for w in lists]


def expected(rows):
    s = sets([r[1] for r in rows])
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (rows[a][1] or "") == (rows[b][1] or "") or (s[a] & s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))]
    root = components(links, range(len(rows)))
    return {root[i]: {rows[j][0] for j in range(len(rows)) if root[j] == root[i]} for i in range(len(rows))}.values()


def corpus():
    random.seed(8)
    word = lambda: f"w{random.randrange(3000)}"
    rows = []
    for g in range(12):
        base = [word() for _ in range(150)]
        for _ in range(random.randrange(1, 25)):
            copy = list(base)
            for _ in range(random.randrange(9)):
                copy[random.randrange(150)] = word()
            rows.append((len(rows), " ".join(copy)))
    # a chain: neighbours are near, the ends are not
    text = [word() for _ in range(200)]
    for i in range(12):
        text[i * 15] = word()
        rows.append((len(rows), " ".join(text)))
    rows += [(900, "a b c"), (901, "a b c"), (902, "a b"), (903, None), (904, ""), (905, " \n"), (906, "x " * 400), (907, "x " * 500), (908, rows[0][1])]
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus()
    out = N.near_duplicates(docs(spark, rows), block=16).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.component_id, set()).add(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)
    assert len(out) == len(rows)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, {frozenset(x) for x in expected(rows)}))
    assert all(min(v) == k for k, v in groups.items())


def test_one_of_each_keeps_one_row(spark):
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (None, "p q r s t u"), (None, "only null"), (None, "only null"), (4, None), (5, "")]
    out = N.one_of_each(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == [("1", "p q r s t u"), ("4", ""), ("None", "only null")]
    assert N.near_duplicates(docs(spark, [])).count() == 0


def test_signature_estimates_probability_jaccard():
    # weights 1..4 on items 0..39 and on items 20..59: compare with the formula
    rng = np.random.default_rng(2)
    w = rng.integers(1, 5, 60).astype(float)
    a, b = np.where(np.arange(60) < 40, w, 0), np.where(np.arange(60) >= 20, w[::-1], 0)
    exact = sum(1 / sum(max(a[k] / a[i], b[k] / b[i]) for k in range(60)) for i in range(60) if a[i] and b[i])
    items = rng.integers(0, 1 << 48, 60).astype(np.uint64)
    doc = np.concatenate([np.zeros(40, int), np.ones(40, int)])
    sig = N.prob_min_hash(doc, np.concatenate([items[:40], items[20:]]), np.concatenate([a[:40], b[20:]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_a_repeated_block_does_not_hide_a_copy(spark):
    rows = []
    for i in range(40):
        base = [f"r{i}_{k}" for k in range(120)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + base[60:] * 100))]
    out = {r.doc_id: r.component_id for r in N.near_duplicates(docs(spark, rows)).collect()}
    assert all(out[2 * i + 1] == 2 * i for i in range(40))

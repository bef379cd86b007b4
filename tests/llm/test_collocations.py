import collections
import random
import re

import pytest

from sparkloom.llm import collocations

from .helpers import DOCS, docs

SPLIT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, longest=3, least=10, within=50):
    """lang, phrase: (a, k, l, r, n, score, inside), from counts of all runs of words."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = tuple(WORD.findall(piece))
            n[lang] += len(w)
            for d in range(1, longest + 1):
                f.update((lang, w[i : i + d]) for i in range(len(w) - d + 1))
    some, out = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}, {}
    for (lang, p), a in some.items():
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(la == lang and len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (la, q), b in some.items())
        out[lang, " ".join(p)] = (a, k, f[lang, p[:k]], f[lang, p[k:]], n[lang], score, inside)
    return out


def got(df):
    return {(r.lang, r.phrase): (r.a, r.k, r.l, r.r, r.n, r.score, r.inside) for r in df.collect()}


def texts(seed, n):
    rng = random.Random(seed)
    common = ["the", "of", "The", "é", "日本", "a\x00b", "ab", "a"]
    out = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for w in words)
        out.append((i, text, "s", rng.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize(("shard", "range_nodes", "longest"), [(1 << 20, 1 << 20, 3), (600, 60, 3), (2000, 25, 4), (300, 200, 2)])
def test_counts_of_all_runs(spark, monkeypatch, shard, range_nodes, longest):
    monkeypatch.setattr(collocations, "SAMPLE_STEP", 3)
    rows = [*texts(1, 150), (7, None, "s", "en"), (8, "", "s", "de"), (9, " \t., ", "s", "fr"), (None, "of the of the " * 40, None, "en")] * 2
    df = docs(spark, rows)
    want = plain([(r[1], r[3]) for r in rows], longest)
    assert want
    assert got(collocations.phrases(df, longest, shard_bytes=shard, range_nodes=range_nodes)) == want


def test_many_ranges_cut_the_children_of_one_word(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE_STEP", 3)
    rows = [(i, f"the x{i % 50} y{i % 7} the the x{i % 50} z", "s", "en") for i in range(900)]
    shards = collocations.tries(docs(spark, rows).repartition(3), 3, 2000).cache()
    bounds = collocations.cuts(shards, 100)
    assert sum(path[0] == b"the" for _, path in bounds) > 3
    assert got(collocations.phrases(docs(spark, rows).repartition(3), shard_bytes=2000, range_nodes=100)) == plain([(r[1], r[3]) for r in rows])


def test_top_and_ties(spark):
    rows = [(i, "b c. a b. é f. x y z. x y", "s", "en") for i in range(12)]
    top = collocations.top_phrases(collocations.phrases(docs(spark, rows)), 4)
    order = sorted((r["rank"], r.phrase) for r in top.collect())
    want = sorted((-v[5], -v[0], p.encode()) for (_, p), v in plain([(r[1], r[3]) for r in rows]).items() if not v[6])
    assert [p for _, p in order] == [p.decode() for *_, p in want[:4]]
    assert [n for n, _ in order] == [1, 2, 3, 4]


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, [10**13 + 1], [10**13 + 3])], "f long, lefts array<long>, rights array<long>")
    assert df.select(collocations._scored().alias("s")).first().s.score == 10**6 * 10**26 // ((10**13 + 1) * (10**13 + 3))


def test_no_documents(spark):
    assert collocations.top_phrases(collocations.phrases(spark.createDataFrame([], DOCS))).collect() == []
    assert collocations.phrases(spark.createDataFrame([(1, None, None, None, 0)], DOCS)).collect() == []

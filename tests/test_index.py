import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import inverted, search


def corpus(spark, n=700, seed=5):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.6 else f"r{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 60))]
        rows.append((i, f"agent{i % 3}", " ".join(words)))
    rows += [(n, None, None), (n + 1, "agent0", ""), (n + 2, "agent1", "c1 c1 c1"), (n + 3, "agent1", "c1 c1 c1")]
    return spark.createDataFrame(rows, "id long, agent_id string, text string")


def asked(spark, n=25, seed=6):
    rng = random.Random(seed)
    rows = [(q, " ".join(rng.choice([f"c{rng.randrange(12)}", f"r{rng.randrange(60)}", "nowhere"]) for _ in range(rng.randrange(1, 8)))) for q in range(n)]
    return spark.createDataFrame([*rows, (900, "nowhere at all"), (901, ""), (902, None)], "query_id int, query string")


def rows(hits):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in hits.collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs = corpus(spark).repartition(5)
    postings = search.postings(docs).join(docs.select("id", "agent_id"), "id").cache()
    index = inverted.InvertedIndex.write(postings, str(tmp_path_factory.mktemp("index") / "i"), group="agent_id", buckets=8, segment=16)
    return postings, index


@pytest.mark.parametrize("prune", [False, True, None])
@pytest.mark.parametrize("k", [1, 7, 2000])
def test_same_hits_as_a_full_scan(spark, made, prune, k):
    postings, index = made
    queries = asked(spark)
    assert rows(index.bm25(queries, k, prune=prune)) == rows(search.bm25(postings, queries, k))


def test_groups_and_scopes(spark, made):
    postings, index = made
    queries = asked(spark)
    want = rows(search.bm25(postings, queries, 5, scope=F.col("agent_id") == "agent1"))
    assert want and rows(index.bm25(queries, 5, group="agent1", prune=True)) == want
    some = postings.where("id % 7 = 3").select("id")
    want = rows(search.bm25(postings, queries, 5, scope=some))
    assert want and rows(index.bm25(queries, 5, scope=some, prune=True)) == want == rows(index.bm25(queries, 5, scope=some, prune=False))
    assert index.bm25(queries, 5, group="nobody").count() == 0


def test_rare_terms_skip_blocks_and_folders(spark, made):
    _, index = made
    index.pruned = inverted.Pruned()
    rare = spark.createDataFrame([(1, "r40 r41 c1"), (2, "r30 c2")], "query_id int, query string")
    assert index.bm25(rare, 1, prune=True).count() == 2
    assert 0 < index.pruned.scored < index.pruned.pairs / 2
    import pyarrow as pa

    found = index._asked(pa.array(["r3"]))
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert 0 < found.agg(F.sum("n")).first()[0] == index.rows.select(F.inline(F.arrays_zip("terms", "ns"))).where("terms = 'r3'").agg(F.sum("ns")).first()[0]


def test_segments_hold_one_group_and_every_passage(made):
    postings, index = made
    held = index.segments().select("grp", F.explode("ids").alias("id")).collect()
    assert sorted((r.id, r.grp) for r in held) == sorted((r.id, r.agent_id) for r in postings.select("id", "agent_id").collect())
    assert index.segments().agg(F.max("n")).first()[0] <= 16


def test_empty_index(spark, tmp_path):
    index = inverted.InvertedIndex.write(corpus(spark).where("false"), str(tmp_path / "i"))
    assert index.bm25(asked(spark), 5).count() == 0


def test_terms_are_those_of_the_jvm(spark):
    from sparkloom.functions.terms import terms
    from sparkloom.functions.text import index_terms

    rng = random.Random(8)
    letters = "abcXYZ éÉßüñİıſKΣσς ΑΣ. 日本ไทय़क् ́\u0307\ue000𝔘😀𐐀_-'\x00\n\xa0０９½²ªﬁǅ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(1500)] + [None, "", "ΟΔΟΣ ΟΔΟΣ", "plain ascii Text_1"]
    import pyarrow as pa

    found, sizes = terms(pa.array(made))
    own, at = [], 0
    for n in sizes.tolist():
        own.append(found[at : at + n].to_pylist())
        at += n
    jvm = spark.createDataFrame(list(enumerate(made)), "i int, t string").select("i", index_terms("t").alias("x")).orderBy("i").collect()
    assert own == [r.x or [] for r in jvm]


def test_many_queries_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 4)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, float(i)]) for i in range(11)] + [(8, [1.0, 0.0])], "query_id int, vector array<double>")
    parts = list(search.blocks(queries, "query_id", "query_id", "vector"))
    assert sum(p.num_rows for p in parts) == 12 and max(p.num_rows for p in parts) <= 4
    assert {r.query_id for r in search.vector_top_k(vectors, queries, 3).collect()} == {7, 8}


def test_a_search_takes_postings_some_at_a_time(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    lists = [[i] * (i % 7) for i in range(200)] + [[1] * 50, None]
    batch = pa.RecordBatch.from_pydict({"x": pa.array(lists, pa.list_(pa.int32()))})
    some = list(inverted.portions(batch, "x", 20))
    assert [x for b in some for x in b.column("x").to_pylist()] == lists and len(some) > 20
    assert max(len(b.column("x").flatten()) for b in some ) <= 20 + 50
    assert [b.num_rows for b in inverted.portions(batch.slice(0, 0), "x", 20)] == [0]
    # rows of an index in one batch, with and without portions, give the same blocks
    texts = spark.range(3000).selectExpr("id", "concat_ws(' ', 'all', concat('w', id % 50), concat('v', id % 7)) as text").coalesce(1)
    index = inverted.InvertedIndex.write(texts, str(tmp_path / "index"), segment=64)
    words = pa.array(["all", "w3", "v5", "none"])
    got = []
    for most in (5, 1 << 30):
        was, inverted.portions.__defaults__ = inverted.portions.__defaults__, (most,)
        try:
            got.append(sorted(map(tuple, index._asked(words, None, True).selectExpr("seg", "word", "n", "string(docs)", "string(tfs)", "string(front_tf)").collect())))
        finally:
            inverted.portions.__defaults__ = was
    assert got[0] == got[1] and np.sum([r[2] for r in got[0] if r[1] == 0]) == 3000


def test_postings_are_packed_and_row_groups_bounded(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    runs = [[1, 2, 255], [], [256, 0], [65536], [7]]
    count = np.array([len(r) for r in runs])
    one = inverted.packed(np.array(sum(runs, [])), count)
    mixed = pa.concat_arrays([inverted.packed(np.array(r, np.int64), np.array([len(r)])) for r in runs])
    assert inverted.unpacked(one, count).tolist() == inverted.unpacked(mixed, count).tolist() == sum(runs, [])
    assert inverted.unpacked(mixed.slice(2, 2), count[2:4]).tolist() == [256, 0, 65536]
    assert inverted.unpacked(pa.array(runs, pa.list_(pa.int32())), count).tolist() == sum(runs, [])
    monkeypatch.setattr(inverted, "ROW_GROUP", 1 << 14)
    texts = spark.range(6000).selectExpr("id", "concat_ws(' ', 'all', concat('w', id), concat('v', id % 700)) as text").coalesce(1)
    index = inverted.InvertedIndex.write(texts, str(tmp_path / "index"), segment=16, buckets=2)
    assert dict(index.rows.dtypes)["docs"] == dict(index.rows.dtypes)["tfs"] == "binary"
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "index" / "blocks").glob("bucket=*/*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) < 200 < max(m.num_rows for m in groups)
    asked = spark.createDataFrame([(1, "w17 v3"), (2, "all v699")], "query_id int, query string")
    assert rows(index.bm25(asked, 9)) == rows(search.bm25(search.postings(texts), asked, 9))


def test_segments_of_long_passages_are_shorter(spark, tmp_path):
    import numpy as np

    assert list(inverted.cuts(np.array([3, 3, 3, 20, 1, 1, 1, 1]), 3, 9)) == [(0, 3), (3, 4), (4, 7), (7, 8)]
    assert list(inverted.cuts(np.zeros(0, np.int64), 3, 9)) == []
    texts = spark.range(40).selectExpr("id", "concat_ws(' ', repeat('word ', 100000), concat('w', id)) as text").coalesce(1)
    index = inverted.InvertedIndex.write(texts, str(tmp_path / "index"))
    held = index.segments().selectExpr("n", "aggregate(dls, 0L, (a, x) -> a + x) as words").collect()
    assert sum(r.n for r in held) == 40 and max(r.words for r in held) <= inverted.SEGMENT_SIZE // 5
    asked = spark.createDataFrame([(1, "w17"), (2, "word")], "query_id int, query string")
    assert rows(index.bm25(asked, 7)) == rows(search.bm25(search.postings(texts), asked, 7))


def test_many_queries_meet_a_segment_in_bounded_steps(spark, made, monkeypatch):
    import numpy as np

    postings, index = made
    asked = spark.createDataFrame([(q, f"r{q % 5} c{q % 12} r{q % 7}") for q in range(60)], "query_id int, query string")
    want = rows(search.bm25(postings, asked, 3))
    monkeypatch.setattr(search, "CELLS", 256)
    block = next(search.blocks(asked.selectExpr("query_id", "transform(split(query, ' '), x -> struct(x as term, 1L as n)) as terms"), "query_id", "query_id", "terms"))
    words = search.Weights.words(block)
    weights = search.Weights(block, words, 100, 1000, np.ones(len(words), np.int64))
    doc, word = np.repeat(np.arange(50), len(words)), np.tile(np.arange(len(words)), 50)
    work = [int(weights.count[word[(doc >= a) & (doc < b)]].sum()) for a, b in weights.steps(doc, word, 50)]
    assert len(work) > 10 and max(work) <= 256 + weights.count.sum()
    assert rows(index.bm25(asked, 3, prune=False)) == want

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import pivots, search


def vectors(spark, n=600, clusters=12, spread=0.15, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(clusters)]
    rows = [(i, [x + rng.gauss(0, spread) for x in centres[i % clusters]], "a" if i % 3 else "b") for i in range(n)]
    rows += [(n, None, "a"), (n + 1, [0.0] * 8, "a"), (n + 2, [float("nan")] + [1.0] * 7, "b"), (n + 3, [1.0, 2.0], "a"), (n + 4, [2.0, 1.0], "b"), (n + 5, rows[5][1], "a"), (n + 6, [-x for x in rows[5][1]], "a")]
    asked = [(i, rows[i * 7][1]) for i in range(20)] + [(50, [-x for x in rows[3][1]]), (51, [0.0] * 8), (52, [1.0, 1.0]), (53, None), (54, [rng.gauss(0, 1) for _ in range(8)]), (55, [1.0] * 3)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, kind string").repartition(4), spark.createDataFrame(asked, "query_id int, vector array<double>")


def rows(hits):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in hits.collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base, asked = vectors(spark)
    base = base.cache()
    return base, asked, pivots.PivotIndex.write(base, str(tmp_path_factory.mktemp("pivots") / "i"), pivots=30)


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_same_hits_as_a_full_scan(made, k):
    base, asked, index = made
    assert rows(index.top_k(asked, k)) == rows(search.vector_top_k(base, asked, k))


def test_scopes(made):
    base, asked, index = made
    some = base.where("kind = 'b'").select("id")
    assert rows(index.top_k(asked, 4, some)) == rows(search.vector_top_k(base, asked, 4, scope=some))
    assert rows(index.top_k(asked, 4, F.col("id") < 40)) == rows(search.vector_top_k(base, asked, 4, scope=F.col("id") < 40))


def test_clusters_are_skipped(spark, made):
    base, asked, index = made
    near = asked.where("query_id < 20")
    index.read = pivots.Read()
    index.top_k(near, 5)
    assert 0 < index.read.compared < index.read.pairs / 3
    cells = index._scored  # folders of other cells are not read
    import numpy as np

    on = np.zeros((1, len(index.pivots) + 1), bool)
    on[0, 2] = True
    import pyarrow as pa

    plan = cells(on, np.ones((1, 8)), pa.table({"query_id": pa.array([1], pa.int32())}), 1, near, None)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "cell" in text.split("PartitionFilters")[1].split("\n")[0]


def test_empty(spark, tmp_path):
    base, asked = vectors(spark)
    index = pivots.PivotIndex.write(base.where("false"), str(tmp_path / "i"))
    assert index.top_k(asked, 3).count() == 0


def test_repeated_query_ids(spark, made):
    base, asked, index = made
    twice = asked.where("query_id < 3").withColumn("query_id", F.lit(1))
    assert rows(index.top_k(twice, 3)) == rows(search.vector_top_k(base, twice, 3))

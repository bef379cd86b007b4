import collections
import random

import corpus_pipeline
from sparkloom.llm import mixing

from .helpers import docs


def test_stages_take_effect(spark, tmp_path):
    bad, good = "vilest rotten scoundrel", ["river", "stone", "garden", "window", "letter", "summer"]
    leak = " ".join(f"q{i}" for i in range(30))
    rows = []
    random.seed(14)
    for i in range(300):
        words = [random.choice(good) + str(random.randrange(97)) for _ in range(40)]
        rows.append((i, " ".join(words) + (f" {bad} {bad}" if i < 60 else ""), f"s{i % 3}"))
    rows += [(1000 + i, rows[100][1] + (" end" if i else ""), "s1") for i in range(4)] + [(2000, "before " + leak + " after", "s2"), (2001, None, None), (2001, None, None)]
    plain = docs(spark, rows, extra=())
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, seen = plain, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == plain.columns
        seen[name] = collections.Counter(r.doc_id for r in df.collect())
    assert set(seen["toxicity"]) == {r[0] for r in rows if r[0] >= 60}
    assert set(seen["near_dedup"]) == set(range(60, 300)) | {2000, 2001} and max(seen["near_dedup"].values()) == 1
    assert set(seen["decontaminate"]) == set(seen["near_dedup"]) - {2000}
    assert max(seen["mix"].values()) <= mixing.MOST
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in out) == seen["mix"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"] and corpus_pipeline.ORACLE_SQL is None

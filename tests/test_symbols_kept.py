from pyspark.sql import functions as F

from sparkloom.api import Engine
from sparkloom.operators import graph, symbols

CODE = "path string, content string, size_kb double"


def ranks(df):
    return {r.id: round(r["rank"], 6) for r in df.collect()}


def test_kept_symbols_equal_a_full_rebuild(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), chunk=lambda files: files.select(F.col("path").alias("source_path"), F.lit(0).alias("chunk_no"), F.col("content").alias("text")))
    code = {
        "lib.py": "def helper():\n    pass\n\n\nclass Box:\n    def put(self):\n        return helper()\n", "a.py": "from .lib import helper, Box\n\n\ndef one():\n    helper()\n    Box.put()\n",
        "b.py": "from . import lib\nimport lib\n\n\ndef two():\n    one()\n", "empty.py": "# nothing\n",
    }

    def files(**changed):
        rows = {**code, **{k + ".py": v for k, v in changed.items()}}
        return spark.createDataFrame([(p, c, 1.0) for p, c in rows.items() if c is not None], CODE)

    def full(now):
        defs, refs = symbols.definitions(now), symbols.references(now)
        return ranks(graph.page_rank(graph.symbol_nodes(defs, now), graph.symbol_edges(defs, refs, now)))

    engine.index("r", files())
    engine.index_symbols("r", files())
    assert ranks(engine.symbol_ranks("r")) == full(files())
    assert [r.path for r in engine.symbol("r", "helper").collect()] == ["lib.py"]
    version = engine.tables["ranks"].pointer()["version"]
    engine.symbol_ranks("r")
    assert engine.tables["ranks"].pointer()["version"] == version  # nothing changed, nothing is made
    new = files(a="from .lib import Box\n\n\ndef three():\n    Box.put()\n    helper()\n", b=None)
    changed = spark.createDataFrame([("a.py",), ("b.py",), ("lib.py",)], "path string")
    plan = engine.sync("r", changed, new)
    assert {r.path: r.action for r in plan.collect()} == {"a.py": "reindexed", "b.py": "removed", "lib.py": "unchanged"}
    assert ranks(engine.symbol_ranks("r")) == full(new)
    assert engine.symbol("r", "two").count() == 0 and engine.symbol("r", "three").count() == 1
    assert sorted(r.path for r in engine.symbol_tables("r")[2].collect()) == ["a.py", "empty.py", "lib.py"]


def test_ranks_from_where_they_were(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(30)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + j) % 29}") for i in range(25) for j in range(3)], "src string, dst string")
    cold = graph.page_rank(nodes, edges)
    more = edges.union(spark.createDataFrame([("n3", "n29"), ("n4", "n1")], "src string, dst string"))
    assert ranks(graph.page_rank(nodes, more, start=cold.where("id <> 'n5'"))) == ranks(graph.page_rank(nodes, more))

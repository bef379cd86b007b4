"""Retrieval quality: recall, reciprocal rank, means by kind, percentiles, regressions, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_path
from .search import legs

TOLERANCE, SLACK = 0.02, 1e-9


def query_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5), names: list[str] | None = None) -> DataFrame:
    """``leg, query_id, kind, recall_<k>.., rr`` from ``leg, query_id, rank, path`` and ``query_id, kind, path``.

    Several hits of one file use up as many ranks; a query without hits scores 0. ``names`` are the legs; without them they are looked up, which
    runs what ``ranked`` is made of once more.
    """
    want = gold.select("query_id", "kind", "path").distinct()
    size = want.groupBy("query_id", "kind").agg(F.count("path").alias("n"))
    hits = ranked.join(want, ["query_id", "path"]).groupBy("leg", "query_id").agg(
        *[F.countDistinct(F.when(F.col("rank") <= k, F.col("path"))).alias(f"h{k}") for k in ks], F.min("rank").alias("first")
    )
    if names is None:
        names = [r.leg for r in ranked.select("leg").distinct().orderBy("leg").collect()]  # a handful
    every = size.select("*", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("leg"))
    recall = [F.when(F.col("n") > 0, F.coalesce(f"h{k}", F.lit(0)) / F.col("n")).otherwise(0.0).alias(f"recall_{k}") for k in ks]
    return every.join(hits, ["leg", "query_id"], "left").select("leg", "query_id", "kind", *recall, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def leg_metrics(vector: DataFrame, lexical: DataFrame, passages: DataFrame, gold: DataFrame, limit: int = 10, ks: tuple[int, ...] = (1, 5), id: str = "id") -> DataFrame:
    """``query_metrics`` of a search's vector, lexical and fused leg: hits count by the file of their passage."""
    hits = legs(vector, lexical, limit, id).join(passages.select(id, clean_path("text").alias("path")), id).where("path is not null")
    # hits without a file take no rank
    place = F.row_number().over(Window.partitionBy("leg", "query_id").orderBy("rank"))
    return query_metrics(hits.withColumn("rank", place).select("leg", "query_id", "rank", "path"), gold, ks, ["fused", "lexical", "vector"])


def means(values: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means over all rows (``by`` null) and of each kind."""
    return values.rollup(by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def percentile(column: str, p: float) -> Column:
    """Nearest-rank percentile; 0 without values."""
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by {column})"), F.lit(0.0))


def compare(base: DataFrame, now: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``keys, metric, base, now, delta, regressed`` of the numeric columns of two reports."""
    metrics = [c for c in base.columns if c not in keys]
    long = lambda df, name: df.unpivot(keys, metrics, "metric", name)
    joined = long(base, "base").join(long(now, "now"), [*keys, "metric"])
    delta = F.col("now") - F.col("base")
    return joined.withColumn("delta", delta).withColumn("regressed", delta < -tolerance)


def gates(report: DataFrame, slack: float = 0.05, least_paraphrase: float = 0.2, least_no_term: float = 0.2) -> DataFrame:
    """``gate, value, required, passed`` from ``leg, kind`` (null: all) ``, recall_1, recall_5, rr``; kinds without queries are skipped."""
    at = lambda leg, kind, m: F.max(F.when((F.col("leg") == leg) & F.col("kind").eqNullSafe(F.lit(kind)), F.col(m)))
    row = report.agg(
        at("fused", "identifier", "recall_1").alias("g1"), F.lit(1.0).alias("r1"),
        at("fused", None, "recall_5").alias("g2"), at("vector", None, "recall_5").alias("r2"),
        at("fused", None, "rr").alias("g3"), (F.greatest(at("vector", None, "rr"), at("lexical", None, "rr")) - slack).alias("r3"),
        at("fused", "paraphrase", "recall_1").alias("g4"), F.lit(least_paraphrase).alias("r4"),
        at("fused", "no-term", "recall_5").alias("g5"), F.lit(least_no_term).alias("r5"),
    )
    names = ["identifier fused R@1", "fused R@5 >= vector R@5", "fused MRR >= best leg", "paraphrase fused R@1", "no-term fused R@5"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"g{i}").alias("value"), F.col(f"r{i}").alias("required")) for i, n in enumerate(names, 1)]))
    return row.select(each.alias("g")).select("g.*").where("value is not null").withColumn("passed", F.col("value") >= F.col("required") - SLACK)


def answer_checks(answers: DataFrame) -> DataFrame:
    """``passed`` of ``answer, must_include, must_not_include``: all of the first and none of the second occur."""
    low = F.lower("answer")
    has = F.forall("must_include", lambda x: F.contains(low, F.lower(x)))
    lacks = F.forall("must_not_include", lambda x: ~F.contains(low, F.lower(x)))
    return answers.withColumn("passed", F.coalesce(has, F.lit(True)) & F.coalesce(lacks, F.lit(True)))

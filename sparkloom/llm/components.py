"""Connected components of a link table by alternating large-star and small-star joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``node, root`` for every node with a link to another one; the root is the smallest node reached.

    ``links`` may repeat pairs, hold either direction and self links; null ends link nothing. Each
    round joins the links with the minimum of each node's neighbourhood, so a node with very many
    links is never gathered in one row. Rounds are written to the shared folder; their number is
    logarithmic in the length of the longest chain.
    """
    small, large = F.least(a, b).alias("y"), F.greatest(a, b).alias("x")
    now = stored(links.where(F.col(a) != F.col(b)).select(large, small).distinct(), name)
    seen = None
    while True:
        both = now.union(now.select("y", "x")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        low = wide.groupBy("x").agg(F.min("y").alias("m"))
        moved = wide.join(low, "x").where("y != m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y"))
        now = stored(moved.union(low.toDF("x", "y")).distinct(), name)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
            return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)
        seen = mark

"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document gets the key -ln(u) / quality, u a fixed hash of its id and text; the smallest keys
are the weighted sample. A source whose target is n times its size and a remainder takes all of its
documents n times (complete epochs), and then, for the remainder, documents in the order of their
keys while at least half of the next one still fits. So a source ends within half a document of its
target, and no document is taken more often than ``most`` times.

No source is ever sorted in one task: documents are counted into ``bins`` of their keys, a running sum
over a source's bins (a bounded table) finds the bin where the budget ends, and only that bin is
counted into bins again, until it has at most ``sort_rows`` rows and is sorted. Rows of equal keys (repeated rows) cannot
be parted; they are counted and take one place in that sort.

Targets share ``total`` times all sizes by the sources' weights; a target stops at ``most`` times its
source's size and the excess is shared again by weight among the others, as long as any is above.

Null or empty texts have size 0 and are taken as often as complete epochs say; a null source is a
source of its own, the last; repeated rows have equal keys and are told apart by their number among
their equals; an empty table gives an empty mix; a null or unknown quality counts as 1.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, stored

MOST, BINS, SORT_ROWS, REPEATS = 3, 1024, 8192, 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words (runs of other than ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle=(1, 2, 3)) -> DataFrame:
    """``source, size, weight``: weights repeat over the sources in code point order, a null source last."""
    at = Window.orderBy(F.col("source").isNull(), "source")
    steps = F.array(*[F.lit(float(c)) for c in cycle])
    return sources.withColumn("weight", F.get(steps, ((F.row_number().over(at) - 1) % len(cycle)).cast("int")))


def targets(sources: DataFrame, total: float = 1.0, most: float = MOST) -> DataFrame:
    """``source, size, weight, target`` from ``source, size, weight``: capped proportional shares.

    The sources that end at their cap are those with the smallest cap per weight. In that order, a
    source is capped if its fair share of what the capped ones before it leave is above its cap.
    """
    caps = sources.withColumn("cap", F.col("size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("size").over(Window.partitionBy()) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shared = caps.withColumn("left", left).withColumn("weights", F.sum("weight").over(rest))
    over = shared.withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights"))
    # capped sources come first in this order: the first that is not sets everybody's share after it
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("left") / F.col("weights")))).over(Window.partitionBy())
    share = first.getField("col2")
    return over.withColumn("share", share).select("source", "size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("share"))).alias("target"))


def uniform() -> Column:
    """A number in (0, 1) from a digest of id and text: 48 bits, the same in every run and engine."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit(""))))
    bits = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def slim(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, size, text_md5, u, quality`` of every row, text left behind."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), uniform().alias("u"))
    if quality is None:
        return rows.withColumn("quality", F.lit(1.0))
    known = quality.where("doc_id is not null and quality > 0").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    return rows.join(known, "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(1.0)))


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weights from 0/1 labels: good documents count twice."""
    return labels.select("doc_id", (F.lit(1.0) + F.coalesce(F.col("quality"), F.lit(0))).alias("quality"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=cyclic_weights, total: float = 1.0, most: float = MOST, bins: int = BINS, sort_rows: int = SORT_ROWS) -> DataFrame:
    """``doc_id, source, text_md5, size, source_size, target, times, taken`` of every row.

    ``times`` counts how often the document is taken and ``taken`` the words of it.
    """
    rows = stored(slim(docs, quality).withColumn("key", -F.log("u") / F.col("quality")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"))
    plan = stored(targets(weights(sources), total, most), "mix-targets").withColumnRenamed("size", "source_size")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumnRenamed("source", "s")
    cut = stored(plan.select("s", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0.0).alias("before"), "budget", F.lit(True).alias("open")), "mix-cut")
    names = ["s", "low", "high", "before", "budget"]
    while True:
        # the cut of a source: keys below low are in, those from high on are out, in between it is open
        inside = rows.select("source", "size", (F.lit(1.0) - F.exp(-F.col("key"))).alias("part")).join(cut.where("open"), F.col("source").eqNullSafe(F.col("s"))).where("part >= low and part < high")
        large = small(inside.groupBy(*names).count().where(F.col("count") > sort_rows).select(*names))
        if not large.limit(1).count():
            break
        narrow = inside.join(large.select(F.col("s").alias("z")), F.col("s").eqNullSafe(F.col("z")), "left_semi")
        narrow = narrow.withColumn("bin", F.least(F.floor((F.col("part") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int"))
        sums = narrow.groupBy(*names, "bin").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("s").orderBy("bin")  # at most ``bins`` rows a source
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(run)).withColumn("last", F.lead("bin").over(run).isNull())
        # the first bin that reaches the budget, or the last one of all
        end = sums.where((F.col("upto") >= F.col("budget")) | F.col("last")).groupBy(*names).agg(F.min(F.struct("bin", "upto", "words")).alias("e"))
        width = (F.col("high") - F.col("low")) / bins
        low, high = F.col("low") + F.col("e.bin") * width, F.when(F.col("e.bin") == bins - 1, F.col("high")).otherwise(F.col("low") + (F.col("e.bin") + 1) * width)
        # a source whose rows all lie in the last place that can be told apart is narrow enough: its equal rows are counted below
        parted = (high - low < F.col("high") - F.col("low")) & (high - low >= 1e-13)
        new = end.select("s", low.alias("low"), high.alias("high"), (F.col("e.upto") - F.col("e.words")).alias("before"), "budget", parted.alias("open"))
        kept = cut.join(end.select(F.col("s").alias("z")), F.col("s").eqNullSafe(F.col("z")), "left_anti").select(*names, F.lit(False))
        cut = stored(new.union(kept), "mix-cut")
    rows = rows.withColumn("part", F.lit(1.0) - F.exp(-F.col("key")))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(cut.select("s", "low", "high", "before"), F.col("source").eqNullSafe(F.col("s")), "left")
    # equal rows are one row with their number; what is left of a source between the cuts are few of these
    same = ["source", "key", "doc_id", "text_md5", "size", "source_size", "target", "epochs", "budget", "before"]
    middle = rows.where("part >= low and part < high").groupBy(*same).agg(F.count("*").alias("rows"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    middle = middle.withColumn("upto", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)))
    half = F.col("upto") + F.col("size") / 2
    more = F.floor((F.col("budget") - half) / F.nullif("size", F.lit(0)))
    fits = F.when((F.col("budget") <= 0) | (half > F.col("budget")), 0).when(F.col("size") == 0, F.col("rows")).otherwise(F.least(F.col("rows"), more + 1)).cast("long")
    middle = middle.withColumn("fits", fits).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {REPEATS}"))))
    middle = middle.withColumn("row", F.explode(F.sequence(F.col("block") * REPEATS, F.least("rows", (F.col("block") + 1) * REPEATS) - 1)))
    middle = middle.withColumn("extra", (F.col("row") < F.col("fits")).cast("long"))
    outer = rows.where("not (part >= low and part < high)").withColumn("extra", ((F.col("budget") > 0) & (F.col("part") < F.col("low"))).cast("long"))
    names = ["doc_id", "source", "text_md5", "size", "source_size", "target", (F.col("epochs") + F.col("extra")).alias("times")]
    out = middle.select(*names).union(outer.select(*names))
    return out.withColumn("taken", F.col("times") * F.col("size"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, **kw).groupBy("doc_id", "source", "text_md5").agg(F.count("*").alias("rows"), F.sum("times").alias("times"))
    key = F.md5(F.coalesce("text", F.lit("")))
    taken = taken.toDF("__id", "__source", "__md5", "__rows", "__times")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (key == F.col("__md5"))
    # repeated rows share what they are taken: n each, and one more for the first of them
    number = F.row_number().over(Window.partitionBy("__id", "__source", "__md5").orderBy(F.lit(1)))
    joined = docs.join(taken, same)
    once = joined.where("__rows = 1").withColumn("__n", F.col("__times"))
    again = joined.where("__rows > 1").withColumn("__n", F.floor(F.col("__times") / F.col("__rows")) + (number <= F.col("__times") % F.col("__rows")).cast("long"))
    out = once.unionByName(again).where("__n > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)

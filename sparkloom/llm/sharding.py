"""Sharding by a k-d tree over metadata, cut at distributed weighted medians.

Points are the groups of equal texts, so that copies stay together; a point weighs the bytes of all
its rows (UTF-8 bytes of the text and ``overhead`` for each row) and lies at five coordinates in
[0, 1): the logarithm of its text's bytes, the least doc_id of its rows, hashes of their least source
and least language, and a hash of its text. A node that stands for n shards is cut along the widest of
its coordinates into n // 2 and the rest, in proportion, until every leaf is one shard. Only a group that
outweighs a whole share of what is left (there are fewer of these than shards) has a shard of its own and no cut.

Where points are heavy, one weighted median parts a node unevenly. So points are cut by tiers of their weight
against a share (a half and more, a quarter and more, ..., less than a 64th): each tier at its own weighted quantile along
the axis of the node, the heaviest first, and what one tier leaves over or short is made good by the next. A tier's quantile
is found by counting: bytes in ``bins`` intervals of the coordinate (a bounded table for each node) and a running sum over these.
For the lightest tier it is counted again within the interval where the quantile lies, until the bytes there are within ``tolerance``
of the node's or cannot be parted. All nodes of a level are counted at once; no node's points meet in one task. A small share of the
text's hash is added to each coordinate, so that points of one source or length can be parted as well.

Null texts count as empty; a null doc_id lies at 0; repeated rows are copies; an empty table gives an
empty result; other columns are ignored but for source and lang.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, stored

OVERHEAD, BINS, TOLERANCE, ROUNDS, PIECES, TIERS, FEW = 16, 2048, 0.0005, 5, 64, 6, 100_000
_AXES = ["x0", "x1", "x2", "x3", "x4"]


def _unit(column):
    """A hash of a column in [0, 1)."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary")) / F.lit(4294967296.0)


def rows_of(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """``doc_id, source, lang, size, text_crc32, node`` of every row; node is the text's digest."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", "lang", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("node"))


def _points(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("node").agg(F.sum("size").alias("w"), F.max("size").alias("size"), F.min("doc_id").alias("id"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    span = groups.agg(F.min("id").alias("id0"), F.max("id").alias("id1"), F.max("size").alias("top"))
    jitter = (F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("x4")
    low, high, top = span.first()  # three numbers
    low, high, top = low or 0, high or 0, max(2, top or 0)
    near = [
        F.log("size") / F.log(F.lit(float(top))),
        F.coalesce((F.col("id").cast("double") - float(low)) / max(1.0, float(high) - float(low)), F.lit(0.0)),
        _unit(F.col("source")),
        _unit(F.col("lang")),
    ]
    placed = groups.select("node", "w", *[x.alias(f"x{i}") for i, x in enumerate(near)], jitter)
    return placed.select("node", "w", *[((F.col(f"x{i}") + F.col("x4") * 1e-3) / 1.0011).alias(f"x{i}") for i in range(4)], "x4")


def tree(points: DataFrame, leaves: int, bins: int = BINS, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``node, shard`` of every point: the leaves of the tree in order, from 0, near equal in weight."""
    share = (points.agg(F.sum("w")).first()[0] or 0) / leaves
    tier = F.when(F.col("w") * (1 << TIERS) < share, TIERS).otherwise(F.least(F.lit(TIERS - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.lit(share) / F.col("w"))) - 1)))
    # shards [a, a + n) of a node of the tree: points carry a, nodes are told apart by it
    state = stored(points.select("*", tier.cast("int").alias("tier"), F.lit(0).alias("a"), F.lit(leaves).alias("n")), "tree-0")
    along, half = F.get(F.array(*_AXES), F.col("axis")), F.floor(F.col("n") / 2).cast("int")
    few = F.broadcast if leaves <= FEW else (lambda nodes: nodes)  # a level has fewer nodes than there are leaves
    for level in range(1, math.ceil(math.log2(max(1, leaves))) + 1):
        ends = [f(c).alias(f"{g}{c}") for c in _AXES for f, g in ((F.min, "lo_"), (F.max, "hi_"))]
        light = F.sum(F.when(F.col("tier") == TIERS, F.col("w")).otherwise(0)).alias("light")
        nodes = state.where("n > 1").groupBy("a", "n").agg(F.sum("w").alias("total"), light, *ends)
        widest = F.array_max(F.array(*[F.struct((F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias("d"), F.lit(i).alias("axis"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high")) for i, c in enumerate(_AXES)]))
        nodes = nodes.withColumn("wide", widest).select("a", "total", "light", (half / F.col("n")).alias("part"), "wide.axis", "wide.low", (F.col("wide.high") + 1e-12).alias("high"))
        nodes = stored(_heavy_cuts(state, stored(nodes, f"nodes-{level}"), bins, few), f"heavy-cuts-{level}")
        goal = F.greatest(F.lit(0.0), F.least(F.col("light"), F.col("light") * F.col("part") + F.coalesce("room", F.lit(0.0))))
        cuts = nodes.where("light > 0").select("a", "total", goal.alias("goal"), "axis", "low", "high", F.lit(0.0).alias("before"), F.lit(False).alias("done"))
        for step in range(rounds):
            cuts = stored(_narrowed(state.where(F.col("tier") == TIERS), cuts, bins, tolerance, few), f"cuts-{level}-{step}")
            if step and not cuts.where("not done").limit(1).count():  # one round is seldom enough
                break
        cuts = nodes.join(few(cuts.select("a", F.col("high").alias("cut"))), "a", "left").select("a", "axis", "low", "high", "cut", "tiers")
        moved = state.join(few(cuts), "a", "left")
        right = F.when(F.col("tier") == TIERS, along >= F.col("cut")).otherwise(_bin(along, bins) >= F.coalesce(F.get("tiers", F.col("tier")), F.lit(0)))
        moved = moved.withColumn("right", F.when(F.col("axis").isNotNull(), F.coalesce(right, F.lit(False))))
        new_n = F.when(F.col("right").isNull(), F.col("n")).when(F.col("right"), F.col("n") - half).otherwise(half)
        state = stored(moved.select("node", "w", *_AXES, "tier", F.when(F.col("right"), F.col("a") + half).otherwise(F.col("a")).alias("a"), new_n.alias("n")), f"tree-{level}")
    return state.select("node", F.col("a").alias("shard"))


def _bin(x, bins: int):
    """The interval of a coordinate between the node's low and high."""
    return F.least(F.floor((x - F.col("low")) / F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-15))), F.lit(bins - 1)).cast("int")


def _heavy_cuts(state: DataFrame, nodes: DataFrame, bins: int, few) -> DataFrame:
    """``nodes`` with ``tiers``, the first interval right of each heavy tier's cut, and ``room``, the bytes that the light tier has to make good.

    Tiers are folded in order, each interval from left to right while at least half of its bytes still fit.
    """
    along = F.get(F.array(*_AXES), F.col("axis"))
    inside = state.where(F.col("tier") < TIERS).join(few(nodes.select("a", "axis", "low", "high", "part")), "a")
    sums = inside.groupBy("a", "part", "tier", _bin(along, bins).alias("bin")).agg(F.sum("w").alias("w"))
    sums = sums.withColumn("whole", F.sum("w").over(Window.partitionBy("a", "tier")))  # at most ``bins`` rows
    lists = sums.groupBy("a", "part").agg(F.array_sort(F.collect_list(F.struct("tier", "bin", "w", "whole"))).alias("each"))  # at most ``bins`` of each tier

    def step(acc, e):
        new = e["tier"] != acc["tier"]
        room = F.when(new, acc["room"] + e["whole"] * F.col("part")).otherwise(acc["room"])
        take = (new | acc["open"]) & (e["w"] / 2 <= room)
        tiers = [F.when(take & (e["tier"] == k), e["bin"] + 1).otherwise(acc[f"c{k}"]).alias(f"c{k}") for k in range(TIERS)]
        return F.struct(e["tier"].alias("tier"), F.when(take, room - e["w"]).otherwise(room).alias("room"), take.alias("open"), *tiers)

    start = F.struct(F.lit(-1).alias("tier"), F.lit(0.0).alias("room"), F.lit(True).alias("open"), *[F.lit(0).alias(f"c{k}") for k in range(TIERS)])
    folded = lists.select("a", F.aggregate("each", start, step).alias("f"))
    found = folded.select("a", F.col("f.room").alias("room"), F.array(*[F.col(f"f.c{k}") for k in range(TIERS)]).alias("tiers"))
    return nodes.join(few(found), "a", "left")


def _alone(points: DataFrame, leaves: int) -> tuple[DataFrame, int]:
    """The groups that outweigh an even share of what the heavier ones leave, and their number (below ``leaves``, or equal where nothing is left)."""
    total, count, least = points.agg(F.sum("w")).first()[0] or 0, 0, None
    rest = total
    while count < leaves and rest > 0:
        share = rest / (leaves - count)
        over = points.where(F.col("w") >= share).agg(F.count("*"), F.sum("w")).first()
        if over[0] == count:
            break
        count, rest, least = over[0], total - (over[1] or 0), share
    bound = F.lit(False) if least is None else F.col("w") >= least
    return points.where(bound), count


def _narrowed(state: DataFrame, nodes: DataFrame, bins: int, tolerance: float, few) -> DataFrame:
    """Every node's interval [low, high] of its axis narrowed to the bin that holds its goal; done: cut at high."""
    todo = nodes.where("not done")
    along = F.get(F.array(*_AXES), F.col("axis"))
    inside = state.join(few(todo), "a").withColumn("x", along).where("x >= low and x < high")
    width = F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-15))
    keys = ["a", "total", "goal", "axis", "low", "high", "before"]
    sums = inside.withColumn("bin", _bin(F.col("x"), bins)).groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.max("x").alias("end"))
    order = Window.partitionBy("a").orderBy("bin")  # at most ``bins`` rows a node
    sums = sums.withColumn("upto", F.col("before") + F.sum("w").over(order)).withColumn("next", F.lead("bin").over(order))
    hit = sums.where("upto >= goal or next is null").groupBy(*keys).agg(F.min(F.struct("bin", "upto", "w", "end")).alias("e"))
    # cutting before or after the bin may be near enough; else the goal lies within
    under, over = F.col("goal") - (F.col("e.upto") - F.col("e.w")), F.col("e.upto") - F.col("goal")
    start, stop = F.col("low") + F.col("e.bin") * width, F.col("low") + (F.col("e.bin") + 1) * width
    flat = width <= 1e-13
    done = (F.least(under, over) <= F.col("total") * tolerance) | flat
    first = under <= over
    high = F.when(done & first, start).when(done, stop).otherwise(stop)
    found = hit.select("a", "total", "goal", "axis", F.when(done, F.col("low")).otherwise(start).alias("low"), high.alias("high"), (F.col("e.upto") - F.col("e.w")).cast("double").alias("before"), done.alias("done"))
    return nodes.where("done").unionByName(found)


def shard(docs: DataFrame, leaves: int, overhead: int = OVERHEAD, pieces: int = PIECES) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots count a shard's rows from 0 without gaps.

    Slots are numbered in the order of a hash and, within, of doc_id and text: each shard in
    ``pieces`` parts, so that no task numbers a whole shard.
    """
    rows = stored(rows_of(docs, overhead), "shard-rows")
    points = stored(_points(rows), "points")
    heavy, alone = _alone(points, leaves)
    heavy = stored(heavy.select("node", (F.row_number().over(Window.orderBy(F.desc("w"), "node")) - 1).alias("shard")), "heavy-points")  # ``leaves`` rows at most
    rest = points.join(small(heavy.select("node")), "node", "left_anti")
    first = min(alone, leaves - 1)  # if all shards are taken, what is left weighs nothing
    places = heavy.union(tree(rest, leaves - first).select("node", (F.col("shard") + first).alias("shard")))
    placed = stored(rows.join(places, "node").withColumn("piece", F.pmod(F.xxhash64("doc_id", "node"), F.lit(pieces))), "sharded")
    part = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # ``pieces`` rows a shard
    base = placed.groupBy("shard", "piece").count().withColumn("base", F.coalesce(F.sum("count").over(part), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "node", "source", "lang"))
    return placed.withColumn("number", number).join(base, ["shard", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number") - 1).cast("long").alias("slot"))


def shard_to_bytes(docs: DataFrame, target_bytes: int, **kw) -> DataFrame:
    """``shard`` with as many leaves as hold ``target_bytes`` each."""
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text) + kw.get("overhead", OVERHEAD))).first()[0] or 0
    return shard(docs, max(1, math.ceil(total / target_bytes)), **kw)

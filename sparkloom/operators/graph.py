"""The symbol graph: module resolution, import and call edges, PageRank, ranked lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import def_id, file_id
from ..storage import kept, small
from . import rank_blocks

DAMPING, ITERATIONS, TOLERANCE = 0.85, 50, 1e-8
# What is tried after a module's path, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".go", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]
#: So many lengths of what aliases begin with are taken one by one; beyond, all lengths of a module are.
MOST_LENGTHS = 64
#: A name with more definitions than this is split over several keys of a join.
HOT_NAME = 1024


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, start: DataFrame | None = None, once: bool = False) -> DataFrame:
    """``id, rank`` of ``id`` and ``src, dst``; parallel edges count each (``once``: as one), dangling ranks go to all, unknown ends are ignored.

    ``start`` (``id, rank``) are the ranks of an earlier graph: where little has changed, few rounds are left. New ids begin with an equal share.
    A round shuffles sums for the ends of edges, and never the edges (see ``rank_blocks``).
    """
    ids = kept(nodes.select("id").distinct(), "nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(1.0))
    numbered, parts = rank_blocks.numbered(ids, n)
    with rank_blocks.tiles(numbered, n, edges, parts, once) as tiles:
        first = numbered.withColumn("first", F.lit(1.0 / n))
        if start is not None:
            first = first.drop("first").join(start.select("id", F.col("rank").alias("was")), "id", "left").withColumn("first", F.coalesce("was", F.lit(1.0 / n))).drop("was")
        ranks = kept(rank_blocks.begun(first, tiles), "ranks")
        total, loose = ranks.agg(F.sum("total"), F.sum("dangling")).first()
        scale, dangling = (1.0 if start is None else 1.0 / total), loose / total
        for _ in range(iterations):
            base = (1 - damping) / n + damping * dangling / n
            new = rank_blocks.moved(tiles, ranks, base, damping, scale)
            # two numbers, summed while the round is written: what it moved, and what the next one deals out to all
            sums = Observation()
            ranks = kept(new.observe(sums, F.sum("total").alias("delta"), F.sum("dangling").alias("dangling")), "ranks")
            delta, dangling, scale = sums.get["delta"], sums.get["dangling"], 1.0
            if delta < tolerance:
                break
    return rank_blocks.named(numbered, ranks, scale)


def _dots_resolved(path: Column) -> Column:
    """A path with ``.`` and ``..`` resolved; null where it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    fold = F.aggregate(
        parts,
        F.array(F.lit("")),
        lambda a, p: F.when(a.isNull(), a).when(p == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))))).otherwise(F.concat(a, F.array(p))),
    )
    return F.array_join(F.slice(fold, 2, F.greatest(F.size(fold) - 1, F.lit(0))), "/")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolved_modules(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``path, module, target``: the file that a module names; modules without one are left out.

    Relative names are tried first, then Python's leading dots, then path aliases ``ord, pattern,
    target`` in their order; for each the first existing file among the usual suffixes. Where all tables have a column ``repo``,
    each repository is resolved by its own files and aliases, and ``repo`` is returned too.
    """
    scope = ["repo"] if "repo" in imports.columns and "repo" in files.columns and (aliases is None or "repo" in aliases.columns) else []
    keys = [*scope, "path", "module"]
    known = imports.select(*keys).distinct()
    folder = _folder(F.col("path"))
    joined = F.concat_ws("/", folder, "module")
    relative = known.where(F.col("module").rlike(r"^\.{1,2}(/|$)")).select(*keys, F.lit(0).alias("tier"), _dots_resolved(joined).alias("base"))
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    rest = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    ups = F.array_join(F.transform(F.sequence(F.lit(1), dots), lambda i: F.when(i == 1, ".").otherwise("..")), "/")
    python = known.where(F.col("path").endswith(".py") & F.col("module").rlike(r"^\.+\w*(\.\w+)*$")).select(*keys, F.lit(1).alias("tier"), _dots_resolved(F.concat_ws("/", folder, ups, rest)).alias("base"))
    absolute = known.where(F.col("path").endswith(".py") & F.col("module").rlike(r"^\w+(\.\w+)*$")).select(*keys, F.lit(2).alias("tier"), F.translate("module", ".", "/").alias("base"))
    tried = relative.unionByName(python).unionByName(absolute)
    if aliases is not None:
        hit = _aliased(known.where(~F.col("module").rlike(r"^\.")), aliases, scope)
        tried = tried.unionByName(hit.select(*keys, (F.lit(10) + F.col("ord")).alias("tier"), _dots_resolved(F.col("to")).alias("base")))
    tried = kept(tried.where("base is not null"), "tried")
    # many files name the same place: each place is looked up once, not once for each module that names it
    options = F.array(*[F.lit(s) for s in SUFFIXES])
    each = tried.select(*scope, "base").distinct().select(*scope, "base", F.posexplode(F.transform(options, lambda s: F.ltrim(F.concat("base", s)))).alias("pos", "file"))
    each = each.withColumn("file", F.regexp_replace("file", "^/", ""))
    there = each.join(files.select(*scope, F.col("path").alias("file")), [*scope, "file"]).groupBy(*scope, "base").agg(F.min(F.struct("pos", "file")).alias("place"))
    found = tried.join(small(kept(there, "places")), [*scope, "base"])
    return found.groupBy(*keys).agg(F.min(F.struct("tier", "place")).alias("b")).select(*keys, F.col("b.place.file").alias("target"))


def _aliased(modules: DataFrame, aliases: DataFrame, scope: list[str]) -> DataFrame:
    """The rows of ``modules`` with ``ord`` and ``to`` for each alias that fits: by equality with a module, or with what a star's pattern begins with.

    The beginnings of a module are as many as its characters, and only those as long as some pattern's are made.
    """
    parts = aliases.select(*scope, "ord", "pattern", F.col("target").alias("to"), F.contains("pattern", F.lit("*")).alias("star"))
    plain = modules.join(parts.where("not star").select(*scope, F.col("pattern").alias("module"), "ord", F.translate("to", "*", "").alias("to")), [*scope, "module"])
    stars = parts.where("star").select(*scope, "ord", "to", F.substring_index("pattern", "*", 1).alias("pre"), F.expr("substring(pattern, instr(pattern, '*') + 1)").alias("post"))
    lengths = [r.n for r in stars.select(F.length("pre").alias("n")).distinct().orderBy("n").limit(MOST_LENGTHS + 1).collect()]
    wanted = F.array(*[F.lit(n) for n in lengths]) if len(lengths) <= MOST_LENGTHS else F.sequence(F.lit(0), F.length("module"))
    begun = modules.withColumn("n", F.explode(wanted)).where("n <= length(module)").withColumn("pre", F.expr("left(module, n)"))
    fits = begun.join(stars, [*scope, "pre"]).where("endswith(module, post)")
    # what the star stands for takes the place of the target's first star; where beginning and end overlap it is nothing
    middle = F.expr("substring(module, n + 1, greatest(0, length(module) - n - length(post)))")
    to = F.when(F.contains("to", F.lit("*")), F.concat(F.substring_index("to", "*", 1), middle, F.expr("substring(to, instr(to, '*') + 1)"))).otherwise(F.col("to"))
    return plain.unionByName(fits.withColumn("to", to).select(*plain.columns))


def symbol_nodes(defs: DataFrame, files: DataFrame) -> DataFrame:
    """``id`` of all definitions and files."""
    return defs.select(def_id("path", "qualified", "line").alias("id")).union(files.select(file_id("path"))).distinct()


def symbol_edges(defs: DataFrame, refs: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``src, dst, kind``: distinct import and call edges from files to definitions.

    ``defs`` has ``path, qualified, name, owner, kind, line, pos``; ``refs`` has ``ref_id, path, kind,
    module, names`` (array of ``struct<local, name>``), ``callee, object``. An import binds to a
    definition by name, or through what the target exports under it; ``*`` to all (exported ones, if
    anything is exported); ``default`` to a definition of that name, else the exported default, else the
    first that is no method. A call binds to the first tier with a match: the same file, what the file
    imports, any definition by qualified name, any by name.
    """
    ids = defs.withColumn("id", def_id("path", "qualified", "line"))
    imports = refs.where("kind = 'import'").select("ref_id", "path", "module", F.posexplode_outer("names").alias("npos", "n"))
    imports = imports.select("ref_id", "npos", "path", "module", F.col("n.local").alias("local"), F.col("n.name").alias("name"))
    modules = resolved_modules(imports, files, aliases)
    bound = imports.join(modules, ["path", "module"]).where("local is not null")
    exports = refs.where("kind = 'export'").select(F.col("path").alias("target"), F.explode("names").alias("n")).select("target", F.col("n.local").alias("inner"), F.col("n.name").alias("outer")).distinct()
    there = ids.select(F.col("path").alias("target"), "id", "qualified", F.col("name").alias("dname"), F.col("kind").alias("dkind"), "pos", "owner")
    named = _named(bound.where("name not in ('*', 'default')"), there, exports)
    # whole modules: what is exported, or all where nothing is
    exporting = exports.select("target").distinct().withColumn("exporting", F.lit(True))
    public = exports.where("inner <> '*'").select("target", F.col("inner").alias("dname")).distinct().withColumn("public", F.lit(True))
    whole = bound.where("name = '*'").join(there, "target").join(exporting, "target", "left").join(public, ["target", "dname"], "left")
    whole = whole.where("exporting is null or public").select("ref_id", "npos", "path", "local", "name", "id", "dname", "qualified")
    default = bound.where("name = 'default'").join(there, "target").join(exports.where("outer = 'default'").select("target", F.col("inner").alias("dlocal")), "target", "left")
    tier = F.when(F.col("dname") == "default", 0).when(F.col("dname") == F.col("dlocal"), 1).when(F.col("dkind") != "METHOD", 2)
    best = default.withColumn("tier", tier).where("tier is not null").groupBy("ref_id", "npos", "path", "local", "name").agg(F.min(F.struct("tier", "pos", "id", "dname", "qualified")).alias("b"))
    best = best.select("ref_id", "npos", "path", "local", "name", "b.id", "b.dname", "b.qualified")
    targets = kept(named.unionByName(whole).unionByName(best), "targets")
    import_edges = targets.select(file_id("path").alias("src"), F.col("id").alias("dst"), F.lit("import").alias("kind"))

    # equal calls of a file bind alike
    calls = kept(refs.where("kind = 'call'").select("path", "callee", "object").distinct(), "calls")
    call_edges = _bound_calls(calls, ids, targets).select(file_id("path").alias("src"), F.col("id").alias("dst"), F.lit("call").alias("kind"))
    return import_edges.unionByName(call_edges).distinct()


def _bound_calls(calls: DataFrame, ids: DataFrame, targets: DataFrame) -> DataFrame:
    """``path, id``: what calls bind to, tier by tier; each tier takes only the calls that those before it left."""
    mine = ids.select("path", "id", "qualified", "name", "owner")
    through = targets.select("path", F.col("local"), F.col("name").alias("iname"), F.col("id").alias("tid"), "dname")
    members = ids.where("owner is not null").select(F.col("owner").alias("o"), F.col("name").alias("m"), "id", F.col("path").alias("mpath"))
    owner = through.where("iname <> '*'").join(ids.select(F.col("id").alias("tid"), F.col("path").alias("tpath"), F.col("name").alias("tname")), "tid")

    def same(left: DataFrame) -> DataFrame:
        owned, named = left.where("object is not null"), left.where("object is null")
        by_owner = owned.join(mine.select("path", F.col("owner").alias("object"), F.col("name").alias("callee"), "id"), ["path", "object", "callee"])
        full = owned.withColumn("q", F.concat_ws(".", "object", "callee")).join(mine.select("path", F.col("qualified").alias("q"), "id"), ["path", "q"])
        bare = mine.select("path", F.explode(F.array("name", "qualified")).alias("callee"), "id").distinct()
        return by_owner.select(*_CALL, "id").union(full.select(*_CALL, "id")).union(named.join(bare, ["path", "callee"]).select(*_CALL, "id"))

    def imported(left: DataFrame) -> DataFrame:
        bare = left.where("object is null").join(through.select("path", F.col("local").alias("callee"), F.col("tid").alias("id")), ["path", "callee"])
        space = left.where("object is not null").join(through.where("iname = '*'").select("path", F.col("local").alias("object"), F.col("dname").alias("callee"), F.col("tid").alias("id")), ["path", "object", "callee"])
        return bare.select(*_CALL, "id").union(space.select(*_CALL, "id"))

    def member(left: DataFrame) -> DataFrame:
        of = left.where("object is not null").join(owner.select("path", F.col("local").alias("object"), "tpath", "tname"), ["path", "object"])
        return of.join(members, (F.col("tpath") == F.col("mpath")) & (F.col("tname") == F.col("o")) & (F.col("callee") == F.col("m"))).select(*_CALL, "id")

    full = F.when(F.col("object").isNotNull(), F.concat_ws(".", "object", "callee")).otherwise(F.col("callee"))
    tiers = [same, imported, member, lambda left: _anywhere(left.withColumn("q", full), ids, "qualified"), lambda left: _anywhere(left.withColumn("q", F.col("callee")), ids, "name")]
    left, out = calls, None
    for number, tier in enumerate(tiers):
        hits = tier(left)
        last = number == len(tiers) - 1
        if not last:
            hits = kept(hits, f"calls-{number}")
            done = hits.select(*[F.col(c).alias(f"__{c}") for c in _CALL]).distinct()
            left = kept(left.join(done, (F.col("path") == F.col("__path")) & (F.col("callee") == F.col("__callee")) & F.col("object").eqNullSafe(F.col("__object")), "left_anti"), "calls-left")
            last = left.isEmpty()
        out = hits.select("path", "id") if out is None else out.union(hits.select("path", "id"))
        if last:
            break
    return out


_CALL = ["path", "callee", "object"]


def _anywhere(calls: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Calls with all definitions of the name ``q``; a name of very many is dealt over as many keys as it needs."""
    defs = ids.select(F.col(name).alias("q"), "id")
    hot = small(defs.groupBy("q").agg(F.ceil(F.count("*") / HOT_NAME).cast("int").alias("parts")).where("parts > 1"))
    dealt = defs.join(hot, "q", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    asked = calls.join(hot, "q", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    return asked.select(*_CALL, "q", "part").join(dealt.select("q", "part", "id"), ["q", "part"]).select(*_CALL, "id")


def _named(bound: DataFrame, there: DataFrame, exports: DataFrame) -> DataFrame:
    keys = ["ref_id", "npos", "path", "local", "name"]
    called = there.select("target", "id", "dname", "qualified", F.explode(F.array_distinct(F.array("dname", "qualified"))).alias("by"))
    direct = bound.join(called.withColumnRenamed("by", "name"), ["target", "name"]).select(*keys, "id", "dname", "qualified", F.lit(0).alias("tier"))
    alias = bound.join(exports, (bound.target == exports.target) & (bound.name == exports.outer)).select(*[bound[k] for k in keys], bound.target, "inner")
    by_alias = alias.join(called.withColumnRenamed("by", "inner"), ["target", "inner"]).select(*keys, "id", "dname", "qualified", F.lit(1).alias("tier"))
    every = direct.union(by_alias)
    least = F.min("tier").over(Window.partitionBy("ref_id", "npos", "local", "name"))
    return every.withColumn("least", least).where("tier = least").select(*keys, "id", "dname", "qualified")


def ranked_symbols(defs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Definitions with their rank (0 without one), and their place by rank, path and line."""
    joined = defs.withColumn("id", def_id("path", "qualified", "line")).join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    # one range of the order after the other: no task numbers all
    ordered = kept(joined.repartitionByRange(F.desc("rank"), "path", "line").sortWithinPartitions(F.desc("rank"), "path", "line").withColumn("__part", F.spark_partition_id()), "ranked")
    part = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = ordered.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(part), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("rank"), "path", "line"))
    return ordered.withColumn("__n", number).join(F.broadcast(base), "__part").withColumn("place", (F.col("__base") + F.col("__n")).cast("long")).drop("__part", "__base", "__n")


def symbols_in_file(defs: DataFrame, path: str) -> DataFrame:
    """The definitions of one file by kind, name and line."""
    return defs.where(F.col("path") == path).orderBy("kind", "name", "line")


def find_symbols(defs: DataFrame, ranks: DataFrame, name: str, kind: str | None = None, prefix: str | None = None, owner: str | None = None, limit: int = 20) -> DataFrame:
    """Definitions of a name or qualified name, best rank first."""
    found = defs.where((F.col("name") == name) | (F.col("qualified") == name))
    for column, value in (("kind", kind), ("owner", owner)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if prefix is not None:
        found = found.where(F.col("path").startswith(prefix))
    best = found.withColumn("id", def_id("path", "qualified", "line")).join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return best.orderBy(F.desc("rank"), "path", "line").limit(limit)


def top_symbols(ranks: DataFrame, least: float = 0.0, top: int = 25) -> DataFrame:
    """``id, rank, line`` of the best definitions."""
    best = ranks.where(F.col("id").startswith("def:") & (F.col("rank") >= least)).orderBy(F.desc("rank"), "id").limit(top)
    return best.withColumn("line", F.concat(F.lit("- "), F.regexp_replace("id", "^def:", ""), F.lit(" ("), F.format_string("%.4f", F.col("rank")), F.lit(")")))

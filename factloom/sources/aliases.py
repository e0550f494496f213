"""Compiler path aliases: imports that look like packages but name the project's own files.

``compilerOptions.paths`` and ``baseUrl`` of the nearest tsconfig.json or jsconfig.json say
what a bare specifier stands for.  Both are inherited along ``extends``, each from where it
is first set, and are relative to the file that sets them.  A specifier is internal only if
what it stands for is a listed file: an alias of a missing file hides no package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import joins
from factloom.operators.graph import stored
from factloom.sources.configs import plain_json

# Endings that an import may leave out, and the sources that a written ending
# may stand for.
ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".d.mts", ".mjs", ".cts", ".d.cts", ".cjs", ".json", ".vue", ".svelte")
SOURCES = {".js": (".ts", ".tsx", ".d.ts", ".jsx"), ".jsx": (".tsx", ".ts", ".d.ts", ".js"), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}
#: How many files long a chain of ``extends`` is followed.
DEPTH = 8
SETTINGS = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def settings(files: DataFrame) -> DataFrame:
    """path, folder, extends (array), base (the folder of baseUrl) and paths (map) of the
    JSON files that set any of them."""
    text = plain_json(F.col("text"))
    wanted = files.where(F.col("path").endswith(".json") & ~paths.has_excluded_segment(F.col("path")) & F.col("text").rlike('"(?:extends|compilerOptions)"'))
    read = wanted.select("path", paths.directory(F.col("path")).alias("folder"), F.from_json(text, SETTINGS).alias("s")).where("s is not null")
    bases = F.when(F.col("s.extends").startswith("["), F.from_json("s.extends", "array<string>")).when(F.col("s.extends").isNotNull(), F.array("s.extends"))
    return read.select("path", "folder", bases.alias("extends"), paths.resolved(F.col("folder"), F.col("s.compilerOptions.baseUrl")).alias("base"), F.col("s.compilerOptions.paths").alias("paths"))


def packages(files: DataFrame) -> DataFrame:
    """package, folder, entry and tsconfig: names of the repository's own packages that only
    one package.json has, and what it names as the file to load."""
    own = files.where((paths.file_name(F.col("path")) == "package.json") & ~paths.has_excluded_segment(F.col("path")))
    read = own.select(paths.directory(F.col("path")).alias("folder"), F.from_json(plain_json(F.col("text")), "name string, typings string, types string, main string, tsconfig string").alias("m"))
    entry = F.coalesce(*[F.when(F.col(f"m.{k}") != "", F.col(f"m.{k}")) for k in ("typings", "types", "main")])
    return read.select(F.col("m.name").alias("package"), "folder", entry.alias("entry"), F.col("m.tsconfig").alias("tsconfig"))


def extended(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, place, spec and base: the files that a configuration extends; base is null for
    one that is not there (installed packages are not read, and have no row)."""
    each = known.select("path", "folder", F.posexplode("extends").alias("place", "spec")).where("spec is not null")
    json = lambda p: F.array(p, F.concat(p, F.lit(".json")))
    near = F.col("spec").rlike(r"^(?:\.{1,2}(?:/|$)|/)")
    local = each.where(near).select("path", "place", "spec", json(paths.resolved(F.col("folder"), F.col("spec"))).alias("at"))
    one = packages(files).where("package is not null").groupBy("package").agg(F.count("*").alias("n"), F.min("folder").alias("home"), F.min("tsconfig").alias("tsconfig"))
    named = each.where(~near).withColumn("package", F.regexp_extract("spec", "^((?:@[^/]+/)?[^/]+)", 1)).join(one, "package")
    below = F.regexp_extract("spec", "^(?:@[^/]+/[^/]+|[^@/][^/]*)/(.+)$", 1)
    inside = lambda rel: paths.resolved(F.col("home"), rel)
    own = F.when(below != "", F.concat(json(inside(below)), F.array(inside(F.concat(below, F.lit("/tsconfig.json")))))).otherwise(F.array(inside(F.coalesce("tsconfig", F.lit("tsconfig.json")))))
    there = named.select("path", "place", "spec", F.when(F.col("n") == 1, own).otherwise(F.array().cast("array<string>")).alias("at"))
    tried = local.unionByName(there).select("path", "place", "spec", F.posexplode_outer("at").alias("rank", "base"))
    listed = tried.join(known.select(F.col("path").alias("base")), "base").groupBy("path", "place").agg(F.min(F.struct("rank", "base")).alias("b"))
    return tried.select("path", "place", "spec").distinct().join(listed, ["path", "place"], "left").select("path", "place", "spec", F.col("b.base").alias("base"))


def effective(files: DataFrame) -> DataFrame:
    """config, base, paths and paths_folder of every configuration, with what it inherits.

    What a file sets goes before its bases, of several bases the later before the earlier,
    and a base's own bases come with it.  So the order of all files that a configuration
    rests on is that of the turns on the way to them, as lists; the first that sets an
    option decides it.
    """
    known = stored(settings(files))
    edges = stored(extended(files, known).where("base is not null").select(F.col("path").alias("at"), "place", "base"))
    way = known.select(F.col("path").alias("config"), F.col("path").alias("at"), F.array().cast("array<int>").alias("turns"), F.array("path").alias("seen"))
    walked = [stored(way)]
    for _ in range(DEPTH):
        ahead = walked[-1].join(edges, "at").where(~F.array_contains("seen", F.col("base")))
        walked.append(stored(ahead.select("config", F.col("base").alias("at"), F.concat("turns", F.array(-F.col("place"))).alias("turns"), F.concat("seen", F.array("base")).alias("seen"))))
        if walked[-1].isEmpty():
            break
    rows = reduce(DataFrame.unionByName, walked).select("config", "at", "turns").join(known.select(F.col("path").alias("at"), "base", F.col("paths").isNotNull().alias("has_paths")), "at")
    first = lambda of: F.min(F.when(of, F.struct("turns", "at", "base")))
    chosen = rows.groupBy("config").agg(first(F.col("base").isNotNull()).alias("b"), first(F.col("has_paths")).alias("p"))
    setting = known.select(F.col("path").alias("at"), "paths", "folder")
    return chosen.select("config", F.col("b.base").alias("base"), F.col("p.at").alias("at")).join(setting, "at", "left").select("config", "base", "paths", F.coalesce("base", "folder").alias("paths_folder"))


def targets(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """config, specifier, place and target: what a specifier stands for, in order.

    Of the keys that fit, an exact one wins, else that of the longest beginning (of equals
    the first); only its targets count, whether they are there or not.  Without a key the
    specifier is one below baseUrl.
    """
    entry = rules.where("paths is not null").select("config", "paths_folder", F.posexplode("paths").alias("at", "key", "to"))
    head, tail = F.substring_index("key", "*", 1), F.regexp_extract("key", r"^[^*]*\*(.*)$", 1)
    entry = entry.select("config", "paths_folder", "at", "to", head.alias("head"), tail.alias("tail"), F.contains("key", F.lit("*")).alias("open"))
    fits = F.when(F.col("open"), F.endswith("specifier", "tail") & (F.length("specifier") >= F.length("head") + F.length("tail"))).otherwise(F.col("specifier") == F.col("head"))
    # Only beginnings as long as one that the configuration has can be keys of it.
    lengths = entry.groupBy("config").agg(F.collect_set(F.length("head")).alias("lengths"))
    long = asked.join(lengths, "config").select("config", "specifier", F.explode(F.filter("lengths", lambda n: n <= F.length("specifier"))).alias("n"))
    hits = long.select("config", "specifier", F.expr("substring(specifier, 1, n)").alias("head")).join(entry, ["config", "head"]).where(fits)
    w = Window.partitionBy("config", "specifier").orderBy("open", F.desc(F.length("head")), "at")
    best = hits.withColumn("r", F.row_number().over(w)).where("r = 1")
    star = F.expr("substring(specifier, length(head) + 1, length(specifier) - length(head) - length(tail))")
    filled = F.when(F.contains("t", F.lit("*")), F.concat(F.substring_index("t", "*", 1), star, F.regexp_extract("t", r"^[^*]*\*(.*)$", 1))).otherwise(F.col("t"))
    by_key = best.select("*", F.posexplode("to").alias("place", "t")).select("config", "specifier", "place", paths.resolved(F.col("paths_folder"), filled).alias("target"))
    plain = asked.join(best.select("config", "specifier"), ["config", "specifier"], "left_anti").join(rules.where("base is not null").select("config", "base"), "config")
    return by_key.unionByName(plain.select("config", "specifier", F.lit(0).alias("place"), paths.resolved(F.col("base"), F.col("specifier")).alias("target"))).where(F.col("target").isNotNull() & ~F.array_contains(F.split("target", "/"), "node_modules"))


def _leads(listed: DataFrame) -> DataFrame:
    """at, index, rank and file: the paths that stand for a listed file, which are few, in
    the order in which a path tries its files: as it is, with an ending, with another; with
    index, of a folder."""
    file = F.col("file")
    less = lambda end: F.substring(file, F.lit(1), F.length(file) - len(end))
    lead = lambda at, index, rank: F.struct(at.alias("at"), F.lit(index).alias("index"), F.lit(rank).alias("rank"))
    written, indexes = [lead(file, False, 0)], []
    for rank, end in enumerate(ENDINGS, 1):
        stem, ends = less(end), F.endswith(file, F.lit(end))
        written.append(F.when(ends, lead(stem, False, rank)))
        of = F.when(stem == "index", ".").when(F.endswith(stem, F.lit("/index")), F.substring(stem, F.lit(1), F.length(stem) - len("/index")))
        indexes.append(F.when(ends & of.isNotNull(), lead(of, True, rank)))
    swaps = [(end, to) for end, all_ in SOURCES.items() for to in all_]
    written += [F.when(F.endswith(file, F.lit(to)), lead(F.concat(less(to), F.lit(end)), False, rank)) for rank, (end, to) in enumerate(swaps, len(ENDINGS) + 1)]
    return listed.select("file", F.explode(F.array_compact(F.array(*written, *indexes))).alias("l")).select("l.*", "file")


def files_of(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """target and file: the first listed file that a path stands for: itself, with an
    ending, or of a folder what its package.json names, else its index.

    Files say which paths lead to them, so a path is not made into all that it may mean."""
    wanted = wanted.select("target").distinct()
    folder = packages(files).where("entry is not null").select(F.col("folder").alias("target"), "entry")
    both = wanted.join(folder, "target", "left")
    to = paths.resolved(F.col("target"), F.col("entry"))
    own = both.select("target", F.col("target").alias("at"), F.lit(False).alias("named"), F.col("entry").isNotNull().alias("has_entry")).distinct()
    named = both.where("entry is not null").select("target", to.alias("at"), F.lit(True).alias("named"), F.lit(True).alias("has_entry")).where(F.col("at").isNotNull() & ~F.array_contains(F.split("at", "/"), "node_modules"))
    tried = own.unionByName(named).join(_leads(files.select(F.col("path").alias("file")).distinct()), "at").where("named or not index or not has_entry")
    way = F.when(F.col("named"), 1).when(F.col("index"), 2).otherwise(0)
    return tried.groupBy("target").agg(F.min(F.struct(way.alias("way"), "index", "rank", "file")).alias("b")).select("target", F.col("b.file").alias("file"))


def internal(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, specifier and file of the ``imports`` (path, specifier, module_kind) that
    aliases lead to a listed file; those of relative and other kinds are left out."""
    bare = imports.where(F.col("module_kind").isin("package", "builtin", "invalid", "subpath-import") & ~F.startswith("specifier", F.lit("node:"))).select("path", "specifier").distinct().withColumn("folder", paths.directory(F.col("path")))
    rules = stored(effective(files))
    named = rules.where(paths.file_name(F.col("config")).isin("tsconfig.json", "jsconfig.json")).select("config", paths.directory(F.col("config")).alias("home"))
    owned = stored(joins.nearest_ancestor(bare, named, "folder", "home", order=[F.desc("config")]).where("config is not null").select("path", "specifier", "config"))
    meant = stored(targets(owned.select("config", "specifier").distinct(), rules))
    found = meant.join(files_of(meant, files), "target").groupBy("config", "specifier").agg(F.min(F.struct("place", "file")).alias("b"))
    return owned.join(found, ["config", "specifier"]).select("path", "specifier", F.col("b.file").alias("file"))


def broken(files: DataFrame) -> DataFrame:
    """path and spec: bases of this repository that are not there, or ambiguous."""
    return extended(files, settings(files)).where("base is null").select("path", "spec").distinct()

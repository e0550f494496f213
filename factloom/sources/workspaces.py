"""Workspaces: which folders belong to which root, by globs and by links between crates.

A glob becomes one regular expression over the segments of a folder.  The globs of a root
come to its folders as one list, by an equi-join on the root; a folder is tried only by the
patterns that begin as it does, up to their first wildcard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import graph, joins
from factloom.sources.configs import plain_json


def _segments(glob: Column) -> Column:
    return F.filter(F.split(glob, "/"), lambda s: ~s.isin("", "."))


def _literal(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def segment_pattern(segment: Column, dots: Column) -> Column:
    """The expression of one segment: ``*`` and ``?`` stand for what is within a segment,
    ``[a-z]`` and ``[!a-z]`` for one character.  Null if a class does not end or there are
    braces.  Without ``dots`` a wildcard does not match a segment that begins with a dot."""
    tokens = F.regexp_extract_all(segment, F.lit(r"\[!?\]?[^\]]*\]|[^*?\[]+|."), F.lit(0))

    def piece(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        negated = inner.startswith("!")
        chars = F.regexp_replace(F.when(negated, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner), r"([\[\]\\^&])", r"\\$1")
        of_class = F.concat(F.when(negated, F.lit("[^/")).otherwise("["), chars, F.lit("]"))
        fit = F.length(token) > F.when(token.startswith("[!"), 3).otherwise(2)
        return F.when(token == "*", "[^/]*").when(token == "?", "[^/]").when(token.startswith("["), F.when(fit & token.endswith("]"), of_class)).otherwise(_literal(token))

    hidden = F.when(dots | segment.startswith("."), "").otherwise(r"(?!\.)")
    pieces = F.transform(tokens, piece)
    return F.when(~segment.rlike("[{}]") & ~F.exists(pieces, lambda p: p.isNull()), F.concat(hidden, F.array_join(pieces, "")))


def glob_pattern(segments: Column, dots: Column) -> Column:
    """The expression of a glob over a folder written as ``a/b/``; ``**`` is any number of
    segments.  Null where a segment has none."""
    some = F.when(dots, "(?:[^/]+/)*").otherwise(r"(?:(?!\.)[^/]+/)*")
    each = F.transform(segments, lambda s: F.when(s == "**", some).otherwise(F.concat(segment_pattern(s, dots), F.lit("/"))))
    return F.when(~F.exists(each, lambda e: e.isNull()), F.concat(F.lit("^"), F.array_join(each, ""), F.lit("$")))


def tried(globs: DataFrame) -> DataFrame:
    """``globs`` with the struct g(glob, dots, head, pattern) that ``fits`` needs; null for
    a glob that is not understood.  head is what comes before the first wildcard."""
    segments = _segments(F.col("glob"))
    at = F.array_position(F.transform(segments, lambda s: s.rlike(r"[*?\[]")), True)
    head = F.array_join(F.when(at > 0, F.slice(segments, F.lit(1), (at - 1).cast("int"))).otherwise(segments), "/")
    made = globs.withColumns({"_head": head, "_pattern": glob_pattern(segments, F.col("dots"))})
    return made.withColumn("g", F.when(F.col("_pattern").isNotNull(), F.struct("glob", "dots", F.col("_head").alias("head"), F.col("_pattern").alias("pattern")))).drop("_head", "_pattern")


def fits(g: Column, folder: Column) -> Column:
    """Whether a glob of ``tried`` matches a folder ('.' for the root)."""
    written = F.when(folder == ".", "").otherwise(F.concat(folder, F.lit("/")))
    return ((g["head"] == "") | F.startswith(written, F.concat(g["head"], F.lit("/")))) & F.rlike(written, g["pattern"])


def matched(globs: DataFrame, folders: DataFrame) -> DataFrame:
    """root, glob and folder of every folder that a glob of its root matches.

    globs(root, glob, dots) and folders(root, folder), both relative to the root ('.')."""
    by = tried(globs).groupBy("root").agg(F.collect_set("g").alias("globs"))
    hits = folders.select("root", "folder").distinct().join(by, "root")
    return hits.select("root", "folder", F.explode(F.filter("globs", lambda g: fits(g, F.col("folder")))).alias("g")).select("root", "g.glob", "folder").distinct()


# npm, pnpm and yarn


def javascript_globs(files: DataFrame) -> DataFrame:
    """root, source, glob of pnpm-workspace.yaml and of ``workspaces`` in package.json."""
    name, folder = paths.file_name(F.col("path")), paths.directory(F.col("path"))
    own = files.where(name.isin("pnpm-workspace.yaml", "package.json") & ~paths.has_excluded_segment(F.col("path"))).select(folder.alias("root"), name.alias("source"), "text")
    block = F.regexp_extract("text", r"(?m)^packages:[ \t]*(?:#[^\n]*)?\r?\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?(?:\n|\z))+)", 1)
    inline = F.regexp_extract("text", r"(?ms)^packages:[ \t]*\[(.*?)\]", 1)
    listed = F.when(inline != "", F.regexp_extract_all(inline, F.lit(r"""(?:^|,)\s*(?:"([^"]*)"|'([^']*)'|([^,'"#]+))"""), F.lit(0))).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[^\n]*$"), F.lit(0)))
    bare = F.transform(listed, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*[-,]?\s*", "")), r"""^(?:"([^"]*)"|'([^']*)'|(.*?))(?:\s+#.*)?$""", "$1$2$3"))
    yaml = own.where("source = 'pnpm-workspace.yaml'").select("root", "source", F.explode(bare).alias("glob"))
    plain = F.when(F.col("source") == "package.json", F.from_json(plain_json(F.col("text")), "workspaces string")["workspaces"])
    array = F.when(plain.startswith("["), F.from_json(plain, "array<string>")).when(plain.startswith("{"), F.from_json(plain, "packages array<string>")["packages"])
    return yaml.unionByName(own.select("root", "source", F.explode(array).alias("glob"))).where("glob != ''").distinct()


def javascript_members(files: DataFrame) -> DataFrame:
    """root, member, source and status of every folder with a package.json below a root
    with workspaces: member, nonmember, or unknown where a glob is not understood.

    An exclusion (!) holds wherever it stands in the list and sees names that begin with a
    dot, which wildcards of inclusions do not.  A name with a dot beside ``**`` or beside an
    exclusion, a glob that leaves the root and braces are unknown.  Folders inside
    node_modules are no members.  Where a root has both lists, pnpm's holds.
    """
    globs = javascript_globs(files)
    first = globs.groupBy("root").agg(F.max("source").alias("source"))  # pnpm-workspace.yaml
    globs = globs.join(first, ["root", "source"])
    negated = F.col("glob").startswith("!")
    body = F.regexp_replace("glob", "^!", "")
    parts = _segments(body)
    dotted = F.exists(parts, lambda s: s.startswith("."))
    odd = body.rlike(r"^(?:/|\\|[A-Za-z]:)") | F.array_contains(parts, "..") | (F.array_contains(parts, "**") & dotted) | F.exists(parts, lambda s: ~s.rlike(r"^(?:\*\*|[A-Za-z0-9._@~+*-]+)$") | (s.contains("**") & (s != "**")))
    globs = globs.select("root", "source", negated.alias("negated"), body.alias("glob"), negated.alias("dots"), odd.alias("odd"), (dotted & ~negated).alias("dotted"))
    rules = tried(globs).groupBy("root", "source").agg((F.bool_or("odd") | (F.bool_or("dotted") & F.bool_or("negated"))).alias("unsure"), F.collect_set(F.when(~F.col("odd"), F.col("g"))).alias("globs"))
    below = files.where((paths.file_name(F.col("path")) == "package.json") & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("node_modules"), F.lit("bower_components")))).select(paths.directory(F.col("path")).alias("place"))
    above = below.select("place", F.explode(paths.ancestors(F.col("place"), strict=True)).alias("root")).join(rules, "root")
    rel = F.when(F.col("root") == ".", F.col("place")).otherwise(F.expr("substring(place, length(root) + 2)"))
    folders = above.withColumn("folder", rel)
    # ``dots`` is what tells an exclusion from an inclusion here.
    said = lambda excluding: F.exists("globs", lambda g: (g["dots"] == excluding) & fits(g, F.col("folder")))
    status = F.when(F.col("unsure"), "unknown").when(~said(True) & said(False), "member").otherwise("nonmember")
    return folders.select("root", F.col("place").alias("member"), "source", status.alias("status"))


# Cargo


def crates(files: DataFrame) -> DataFrame:
    """root, named (it has a package), workspace (null, or members and exclude), pointer
    (package.workspace), links (folders of path dependencies), shared and inherited
    (workspace.dependencies, and the keys that take theirs from it) of each Cargo.toml."""

    def read(text: str | None) -> dict:
        import tomllib

        try:
            doc = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return {}
        table = lambda x: x if isinstance(x, dict) else {}
        strings = lambda x: [s for s in x if isinstance(s, str)] if isinstance(x, list) else []
        work, links, inherited = doc.get("workspace"), [], []
        for of in (doc, *table(doc.get("target")).values()):
            for section in ("dependencies", "dev-dependencies", "build-dependencies"):
                for key, entry in table(table(of).get(section)).items():
                    if isinstance(table(entry).get("path"), str):
                        links.append(entry["path"])
                    if table(entry).get("workspace") is True:
                        inherited.append(key)
        shared = [(k, v if isinstance(v, str) else table(v).get("version"), table(v).get("package") or k) for k, v in table(table(work).get("dependencies")).items()]
        pointer = table(doc.get("package")).get("workspace")
        return {
            "named": isinstance(doc.get("package"), dict), "pointer": pointer if isinstance(pointer, str) else None, "links": sorted(set(links)), "inherited": sorted(set(inherited)),
            "workspace": {"members": strings(work.get("members")), "exclude": strings(work.get("exclude"))} if isinstance(work, dict) else None,
            "shared": [{"key": k, "constraint": c if isinstance(c, str) else None, "name": n if isinstance(n, str) else k} for k, c, n in shared],
        }

    fields = [
        ("root", pa.string()), ("named", pa.bool_()), ("pointer", pa.string()), ("links", pa.list_(pa.string())), ("inherited", pa.list_(pa.string())),
        ("workspace", pa.struct([("members", pa.list_(pa.string())), ("exclude", pa.list_(pa.string()))])), ("shared", pa.list_(pa.struct([("key", pa.string()), ("constraint", pa.string()), ("name", pa.string())]))),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"root": root, **read(text)} for root, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    own = files.where((paths.file_name(F.col("path")) == "Cargo.toml") & ~paths.has_excluded_segment(F.col("path"))).select(paths.directory(F.col("path")).alias("root"), "text")
    return own.mapInArrow(run, "root string, named boolean, pointer string, links array<string>, inherited array<string>, workspace struct<members: array<string>, exclude: array<string>>, shared array<struct<key: string, constraint: string, name: string>>")


def _inside(root: str, place: str) -> Column:
    """``place`` relative to ``root``, '.' for the root itself, null outside it."""
    below = F.when(F.col(root) == ".", F.col(place)).when(F.startswith(place, F.concat(root, F.lit("/"))), F.expr(f"substring({place}, length({root}) + 2)"))
    return F.when(F.col(root) == F.col(place), ".").otherwise(below)


def cargo_members(manifests: DataFrame) -> DataFrame:
    """root and member: the crates of each workspace, of ``crates``.

    A crate's root is where it points, or else the nearest folder at or above it that has a
    workspace and does not exclude it.  It is a member if the root's globs name it, if it is
    the root, or if a member leads to it by path, over any number of crates.
    """
    manifests = graph.stored(manifests)
    roots = manifests.where("workspace is not null").select("root", "workspace.members", "workspace.exclude")
    named = manifests.where("named").select(F.col("root").alias("place"), "pointer")
    pointed = named.where("pointer is not null").select("place", paths.resolved(F.col("place"), F.col("pointer")).alias("root"), F.lit(0).alias("away"))
    above = named.where("pointer is null").select("place", F.posexplode(paths.ancestors(F.col("place"))).alias("away", "root"))
    tried = pointed.unionByName(above.select("place", "root", "away")).join(roots, "root")
    out = F.exists(F.coalesce("exclude", F.array().cast("array<string>")), lambda x: paths.is_within(F.col("place"), paths.resolved(F.col("root"), x)))
    home = tried.where(~out | (F.col("root") == F.col("place"))).groupBy("place").agg(F.min(F.struct("away", "root")).alias("b")).select("place", F.col("b.root").alias("root"))
    home = graph.stored(home.withColumn("folder", _inside("root", "place")))
    globs = roots.select("root", F.explode("members").alias("glob")).withColumn("dots", F.lit(True))
    listed = matched(globs, home.where("folder is not null")).join(home, ["root", "folder"]).select("root", "place").unionByName(home.where("root = place").select("root", "place"))
    links = manifests.where("named").select(F.col("root").alias("place"), F.explode("links").alias("to")).select("place", paths.resolved(F.col("place"), F.col("to")).alias("to"))
    same = links.join(home.select("place", "root"), "place").join(home.select(F.col("place").alias("to"), F.col("root").alias("root")), ["to", "root"])
    node = lambda root, place: F.concat_ws("\u0000", root, place)
    edges = listed.distinct().select(F.concat(F.lit("\u0000"), "root").alias("src"), node("root", "place").alias("dst")).unionByName(same.select(node("root", "place").alias("src"), node("root", "to").alias("dst")))
    reach = graph.closure(edges, starts=listed.select(F.concat(F.lit("\u0000"), "root").alias("src")))
    return reach.select(F.split("dst", "\u0000")[0].alias("root"), F.split("dst", "\u0000")[1].alias("member")).distinct()


def inherited_dependencies(files: DataFrame) -> DataFrame:
    """member, key, name and constraint of dependencies that a crate takes from its
    workspace; name and constraint are null where the workspace has no such key."""
    manifests = graph.stored(crates(files))
    asked = manifests.select(F.col("root").alias("member"), F.explode("inherited").alias("key")).join(cargo_members(manifests), "member")
    shared = manifests.select("root", F.explode("shared").alias("s")).select("root", "s.key", "s.name", F.coalesce("s.constraint", F.lit("*")).alias("constraint"))
    return asked.join(shared, ["root", "key"], "left").select("member", "key", "name", "constraint")


# Features


def features(files: DataFrame) -> DataFrame:
    """crate, feature, item: the features of each Cargo.toml (item null for an empty one),
    and its optional dependencies as rows without a feature."""

    def rows(text: str | None) -> list[tuple[str | None, str | None]]:
        import tomllib

        try:
            doc = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return []
        table = lambda x: x if isinstance(x, dict) else {}
        out: list[tuple[str | None, str | None]] = []
        for of in (doc, *table(doc.get("target")).values()):
            for section in ("dependencies", "build-dependencies"):
                out += [(None, k) for k, e in table(table(of).get(section)).items() if table(e).get("optional") is True]
        for name, items in table(doc.get("features")).items():
            listed = [i for i in items if isinstance(i, str)] if isinstance(items, list) else []
            out += [(name, i) for i in listed] or [(name, None)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(crate, *r) for crate, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows(text)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in list(zip(*found, strict=True)) or [()] * 3], names=["crate", "feature", "item"])

    own = files.where((paths.file_name(F.col("path")) == "Cargo.toml") & ~paths.has_excluded_segment(F.col("path"))).select(paths.directory(F.col("path")).alias("crate"), "text")
    return own.mapInArrow(run, "crate string, feature string, item string")


def feature_gates(listed: DataFrame) -> DataFrame:
    """crate, key and feature: the features that turn each optional dependency on, over any
    number of features; a dependency that none turns on has a row without one.

    ``dep:key`` and ``key/feature`` turn it on, ``key?/feature`` does not.  A dependency that
    no ``dep:`` names and that no feature is named after is a feature of its own name.
    """
    listed = graph.stored(listed)
    keys = listed.where("feature is null").select("crate", F.col("item").alias("key")).distinct()
    given = listed.where("feature is not null")
    names = given.select("crate", F.col("feature").alias("key")).distinct()
    items = given.where("item is not null").select("crate", "feature", "item").distinct()
    said = items.select("crate", "feature", "item", F.when(F.startswith("item", F.lit("dep:")), F.substring("item", 5, 1 << 30)).otherwise(F.regexp_extract("item", r"^([^/?]+)/", 1)).alias("key"))
    direct = said.where("key != ''").join(keys, ["crate", "key"]).select("crate", "key", "feature")
    hidden = said.where(F.startswith("item", F.lit("dep:"))).select("crate", "key")
    alone = keys.join(names, ["crate", "key"], "left_anti")
    bare = items.select("crate", F.col("item").alias("key"), "feature").join(alone, ["crate", "key"])
    implicit = alone.join(hidden, ["crate", "key"], "left_anti").select("crate", "key", F.col("key").alias("feature"))
    starts = graph.stored(direct.unionByName(bare).unionByName(implicit).distinct())
    node = lambda c: F.concat_ws("\u0000", "crate", c)
    steps = items.join(names.unionByName(keys).distinct().withColumnRenamed("key", "item"), ["crate", "item"]).select(node("feature").alias("src"), node("item").alias("dst"))
    above = graph.closure(steps).select(F.col("dst").alias("node"), F.split("src", "\u0000")[1].alias("above"))
    more = starts.withColumn("node", node("feature")).join(above, "node").select("crate", "key", F.col("above").alias("feature"))
    return keys.join(starts.unionByName(more).distinct(), ["crate", "key"], "left").select("crate", "key", "feature")

"""Lockfiles: files(path, text) to locked packages and the edges between them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names, paths
from factloom.operators.graph import shuffled, stored
from factloom.sources.configs import plain_json

#: Columns of the packages of install trees.
PACKAGE = ["lockfile", "key", "name", "version", "dev", "origin", "requires", "peers"]


def _table(variant: str, *places: str) -> Column:
    """The first of the places in a variant that is an object of strings, else empty."""
    return F.coalesce(*[F.try_variant_get(variant, p, "map<string,string>") for p in places], F.create_map().cast("map<string,string>"))


def npm_packages(files: DataFrame) -> DataFrame:
    """lockfile, key, name, version, dev, origin, requires and peers (names) of the
    packages of package-lock.json files that have a packages map; the root has key ''."""
    rows = files.where(paths.file_name(F.col("path")).isin("package-lock.json", "npm-shrinkwrap.json")).withColumn("v", F.try_parse_json("text"))
    each = rows.select(F.col("path").alias("lockfile"), F.explode(F.try_variant_get("v", "$.packages", "map<string,variant>")).alias("key", "p"))
    table = lambda f: F.coalesce(F.try_variant_get("p", f"$.{f}", "map<string,string>"), F.create_map().cast("map<string,string>"))
    requires = F.array_union(F.map_keys(table("dependencies")), F.map_keys(table("optionalDependencies")))
    text = lambda f: F.try_variant_get("p", f"$.{f}", "string")
    name = F.when(F.col("key") == "", text("name")).otherwise(F.coalesce(text("name"), names.name_in_modules(F.col("key"))))
    return each.select("lockfile", "key", name.alias("name"), text("version").alias("version"), F.coalesce(F.try_variant_get("p", "$.dev", "boolean"), F.lit(False)).alias("dev"), names.registry_origin(text("resolved")).alias("origin"), requires.alias("requires"), F.map_keys(table("peerDependencies")).alias("peers"))


class _Number(str):
    """A number as a text has it."""


def _plain(value):
    """Half a pair of surrogates is no character: '?', as in Spark."""
    return str(value).encode("utf-8", "replace").decode() if type(value) is str else value


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key is repeated")
    return found


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
_HALVES = json.JSONDecoder(object_pairs_hook=lambda pairs: _object([(_plain(k), _plain(v)) for k, v in pairs]), parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


def _parsed(text: str | None) -> dict:
    """The object of a JSON text; empty where it is none, or does not parse.  What Spark's
    parser leaves out (a key that repeats, NaN) is left out here too."""
    try:
        found = (_HALVES if "\\u" in (text or "") else _DECODER).raw_decode((text or "").lstrip(" \t\n\r"))[0]
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _shown(value) -> str:
    """A parsed value as JSON again, numbers as they were."""
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k) + ":" + _shown(v) for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_shown, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value)


def _keys(table) -> list[str]:
    return list(table) if isinstance(table, dict) else []


def _nested(top: dict) -> Iterator[tuple]:
    """key, name, version, resolved, dev, odd and requires of the packages that a lockfile
    nests; odd is JSON of what of them is no plain text or truth value."""
    todo = [("", top["dependencies"])]
    while todo:
        base, level = todo.pop()
        for name, p in level.items() if isinstance(level, dict) else ():
            key, p = f"{base}node_modules/{name}", p if isinstance(p, dict) else {}
            version, resolved, dev = p.get("version"), p.get("resolved"), p.get("dev")
            odd = None
            if not (version is None or type(version) is str) or not (resolved is None or type(resolved) is str) or not (dev is None or type(dev) is bool):
                odd, version, resolved, dev = _shown({"version": version, "resolved": resolved, "dev": dev}), None, None, None
            yield key, name, version, resolved, dev, odd, _keys(p.get("requires"))
            if "dependencies" in p:
                todo.append((key + "/", p["dependencies"]))


#: Files whose packages are given on at once.
FILES = 256


def npm_tree_packages(files: DataFrame) -> DataFrame:
    """As ``npm_packages``, of package-lock.json files that only nest packages in packages
    (version 1), with the install paths that the nesting means.  Such a file does not say
    what the root requires; package.json beside it does.  A file is parsed once."""
    wanted = files.where(paths.file_name(F.col("path")).isin("package-lock.json", "npm-shrinkwrap.json", "package.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, FILES):
                batch, rows = whole.slice(first, FILES), []
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    top = _parsed(text)
                    if path.rpartition("/")[2] == "package.json":
                        asked = dict.fromkeys(k for f in ("dependencies", "devDependencies", "optionalDependencies") for k in _keys(top.get(f)))
                        rows.append((path, None, None, None, None, None, None, list(asked)))
                    elif "dependencies" in top and "packages" not in top:
                        rows.append((path, "", None, None, None, None, None, None))
                        rows += [(path, *p) for p in _nested(top)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                types = [pa.string()] * 5 + [pa.bool_(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["path", "key", "name", "version", "resolved", "dev", "odd", "requires"])

    read = stored(wanted.select("path", "text").mapInArrow(run, "path string, key string, name string, version string, resolved string, dev boolean, odd string, requires array<string>"))
    other = lambda f, kind: F.coalesce(f, F.try_variant_get(F.try_parse_json("odd"), f"$.{f}", kind))
    no = F.array().cast("array<string>")
    columns = [F.col("path").alias("lockfile"), "key", "name", other("version", "string").alias("version"), F.coalesce(other("dev", "boolean"), F.lit(False)).alias("dev"), names.registry_origin(other("resolved", "string")).alias("origin"), "requires", no.alias("peers")]
    declared = read.where("key is null").select(paths.directory(F.col("path")).alias("folder"), "requires")
    roots = read.where("key = ''").drop("requires").withColumn("folder", paths.directory(F.col("path"))).join(shuffled(declared), "folder")
    return read.where("key != ''").select(*columns).unionByName(roots.select(*columns)).select(PACKAGE)


def bun_packages(files: DataFrame) -> DataFrame:
    """As ``npm_packages``, of bun.lock files: keys are turned to install paths, those of
    workspaces to their folders ('' for the root).  A file that does not parse has no rows."""
    rows = files.where(paths.file_name(F.col("path")) == "bun.lock").select(F.col("path").alias("lockfile"), F.try_parse_json(plain_json(F.col("text"))).alias("v"))
    first = r"^((?:@[^/]+/)?[^/]+)"
    inside = lambda k: F.regexp_replace(k, r"((?:@[^/]+/)?[^/]+)(/|$)", "node_modules/$1$2")
    # The text is parsed once: both tables are taken from it, and exploded together.
    table = lambda f: F.coalesce(F.map_entries(F.try_variant_get("v", f"$.{f}", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    listed = lambda f, space: F.transform(table(f), lambda e: F.named_struct(F.lit("k"), e["key"], F.lit("p"), e["value"], F.lit("is_space"), F.lit(space)))
    named = F.transform(F.filter(table("workspaces"), lambda e: (e["key"] != "") & F.try_variant_get(e["value"], "$.name", "string").isNotNull()), lambda e: F.named_struct(F.lit("name"), F.try_variant_get(e["value"], "$.name", "string"), F.lit("space"), e["key"]))
    each = rows.select("lockfile", named.alias("named"), F.explode(F.concat(listed("packages", False), listed("workspaces", True))).alias("e")).select("lockfile", "named", "e.*")
    each = each.withColumns({"first": F.regexp_extract("k", first, 1), "rest": F.regexp_replace("k", first + "/?", "")})
    within = F.when(~F.col("is_space"), F.transform(F.filter("named", lambda n: n["name"] == F.col("first")), lambda n: n["space"]))
    each = each.select("lockfile", "k", "p", "is_space", "rest", F.explode_outer(within).alias("space"))
    # What is installed inside a workspace's folder is keyed by the workspace's name.
    key = F.when(F.col("is_space"), F.col("k")).when(F.col("space").isNotNull() & (F.col("rest") != ""), F.concat("space", F.lit("/"), inside(F.col("rest")))).otherwise(inside(F.col("k")))
    ident = F.try_variant_get("p", "$[0]", "string")
    of_space = [F.map_keys(_table("p", f"$.{f}")) for f in ("dependencies", "devDependencies", "optionalDependencies")]
    needs = F.array_union(F.map_keys(_table("p", "$[2].dependencies", "$[1].dependencies")), F.map_keys(_table("p", "$[2].optionalDependencies", "$[1].optionalDependencies")))
    either = lambda space, package: F.when(F.col("is_space"), space).otherwise(package)
    none = F.lit(None).cast("string")
    columns = {
        "key": key, "name": either(F.try_variant_get("p", "$.name", "string"), names.name_of_key(ident)), "version": either(none, names.version_of_key(ident)), "dev": F.lit(False),
        "origin": either(none, names.registry_origin(F.try_variant_get("p", "$[1]", "string"))), "requires": either(F.array_union(F.array_union(of_space[0], of_space[1]), of_space[2]), needs),
        "peers": either(F.map_keys(_table("p", "$.peerDependencies")), F.map_keys(_table("p", "$[2].peerDependencies", "$[1].peerDependencies"))),
    }
    return each.select("lockfile", *[c.alias(n) for n, c in columns.items()]).select(PACKAGE)


def npm_peers(packages: DataFrame) -> DataFrame:
    """lockfile, direct, member and resolved: what direct dependencies expect beside them,
    and whether a package of that name is at the top."""
    directs = packages.where("key = ''").select("lockfile", F.explode("requires").alias("direct"))
    placed = directs.withColumn("key", F.concat(F.lit("node_modules/"), "direct")).join(shuffled(packages.select("lockfile", "key", "peers")), ["lockfile", "key"])
    need = placed.select("lockfile", "direct", F.explode("peers").alias("member"))
    top = packages.select("lockfile", F.regexp_extract("key", r"^node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("member"), F.lit(True).alias("there")).where("member != ''")
    return need.join(shuffled(top.distinct()), ["lockfile", "member"], "left").select("lockfile", "direct", "member", F.coalesce("there", F.lit(False)).alias("resolved"))


def _pnpm_documents(files: DataFrame) -> DataFrame:
    """path, n, major and text of pnpm-lock.yaml: how many documents it has, and of the last
    its version and text.  An environment's lockfile may stand before the project's."""
    own = files.where(paths.file_name(F.col("path")) == "pnpm-lock.yaml")
    all_ = F.filter(F.split("text", r"(?m)^---(?:[ \t][^\n]*)?\r?$"), lambda d: d.rlike(r"(?m)^\s*[^\s#]"))
    last = own.select("path", F.size(all_).alias("n"), F.try_element_at(all_, F.lit(-1)).alias("text"))
    return last.select("path", "n", F.regexp_extract("text", r"""(?m)^lockfileVersion:\s*['"]?(\d+)""", 1).alias("major"), "text")


PNPM_MAJORS = ("6", "9")


def pnpm_problems(files: DataFrame) -> DataFrame:
    """lockfile and reason of each pnpm-lock.yaml that ``pnpm`` does not read."""
    reason = F.when((F.col("n") < 1) | (F.col("n") > 2), F.concat(F.lit("expected one or two documents, found "), F.col("n").cast("string"))).when(~F.col("major").isin(*PNPM_MAJORS), F.concat(F.lit("lockfile version "), F.when(F.col("major") == "", "none").otherwise(F.col("major")), F.lit(" is not read")))
    return _pnpm_documents(files).select(F.col("path").alias("lockfile"), F.coalesce(reason, F.when(F.col("n").isNull(), "no text")).alias("reason")).where("reason is not null")


def pnpm(files: DataFrame) -> DataFrame:
    """lockfile, src, name, reference, dev and dst of pnpm-lock.yaml files, versions 6 and 9
    (of a file of two documents the last; see ``pnpm_problems`` for the others).

    src is a package's key (name@version, with what its peers add) or 'importer:' and the
    project's folder; dst is the key that the reference picks, null for links and for what
    is not locked.  The format's indentation is read, a file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"dependencies": False, "optionalDependencies": False, "devDependencies": True}
        for batch in batches:
            rows, keys = [], []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                section, owner, dev, name = "", None, None, None
                for line in (text or "").splitlines():
                    word = line.strip()
                    if not word or word.startswith("#"):
                        continue
                    deep = len(line) - len(line.lstrip(" "))
                    key, _, value = word.partition(": ") if ": " in word else (word.removesuffix(":"), "", "")
                    key, value = key.strip("'\""), value.strip().strip("'\"")
                    if deep == 0:
                        section, owner, dev = key, "importer:." if key in kinds else None, kinds.get(key)
                    elif section in kinds:  # version 6 with a single importer
                        if deep == 2:
                            name = key
                            if value:
                                rows.append((path, owner, name, value, dev))
                        elif key == "version":
                            rows.append((path, owner, name, value, dev))
                    elif section == "importers":
                        if deep == 2:
                            owner, dev = "importer:" + key, None
                        elif deep == 4:
                            dev = kinds.get(key)
                        elif deep == 6 and dev is not None:
                            name = key
                        elif deep == 8 and key == "version" and dev is not None:
                            rows.append((path, owner, name, value, dev))
                    elif section in ("packages", "snapshots"):
                        if deep == 2:
                            owner, dev = key.removeprefix("/"), None
                            keys.append((path, owner))
                        elif deep == 4:
                            dev = kinds.get(key)
                        elif deep == 6 and dev is not None and value:
                            rows.append((path, owner, key, value, False))
            parts = [[(*r, 0) for r in rows], [(p, k, None, None, None, 1) for p, k in keys]]
            columns = list(zip(*(x for part in parts for x in part), strict=True)) or [()] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types, strict=True)], names=["lockfile", "src", "name", "reference", "dev", "is_key"])

    rows = _pnpm_documents(files).where(F.col("n").between(1, 2) & F.col("major").isin(*PNPM_MAJORS)).select("path", "text").mapInArrow(run, "lockfile string, src string, name string, reference string, dev boolean, is_key int")
    keys = rows.where("is_key = 1").select("lockfile", F.col("src").alias("dst")).distinct()
    need = rows.where("is_key = 0").drop("is_key")
    bare = F.regexp_replace("reference", "^/", "")
    asked = need.select("*", F.explode(F.array(F.concat("name", F.lit("@"), bare), bare)).alias("dst"))
    hits = asked.join(shuffled(keys), ["lockfile", "dst"], "left_semi").groupBy("lockfile", "src", "name", "reference").agg(F.min("dst").alias("dst"))
    return need.join(shuffled(hits), ["lockfile", "src", "name", "reference"], "left")


def pipfile_packages(files: DataFrame) -> DataFrame:
    """lockfile, name, version (without ==) and dev of Pipfile.lock files."""
    rows = files.where(paths.file_name(F.col("path")) == "Pipfile.lock").withColumn("v", F.try_parse_json("text"))
    each = lambda section, dev: rows.select(F.col("path").alias("lockfile"), F.explode(F.try_variant_get("v", f"$.{section}", "map<string,variant>")).alias("name", "p"), F.lit(dev).alias("dev"))
    both = each("default", False).unionByName(each("develop", True))
    return both.select("lockfile", names.python_name(F.col("name")).alias("name"), F.regexp_replace(F.try_variant_get("p", "$.version", "string"), "^==+", "").alias("version"), "dev")


def _places(key: str) -> list[str]:
    """Where a package looks for others: from its own folder outwards, each step cuts the
    last /node_modules/...; the root comes last."""
    places, at, cut = [], "/" + key, True
    while cut:
        places.append(at[1:] + "/node_modules/" if at[1:] else "node_modules/")
        at, cut, _ = at.rpartition("/node_modules/")
    return places if places[-1] == "node_modules/" else [*places, "node_modules/"]


#: Lockfiles whose edges are given on at once.
LOCKFILES = 256


def npm_edges(packages: DataFrame) -> DataFrame:
    """lockfile, src and dst (keys; dst null if unresolved) and name of every requirement:
    the nearest node_modules at or above the package that holds the name; a workspace's
    folder also sees those of the root.  The packages of a lockfile, which was one text,
    come together once and are looked up there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, LOCKFILES):
                part = batch.slice(first, LOCKFILES)
                sizes = part.column(1).value_lengths().to_numpy()
                keys, requires = part.column(1).flatten().flatten()
                needs = requires.value_lengths().fill_null(0).to_numpy()
                named = requires.flatten()
                key, name, found = keys.to_numpy(zero_copy_only=False), named.to_numpy(zero_copy_only=False), []
                at = next_ = 0
                for size in sizes.tolist():
                    known = set(key[at : at + size])
                    for i in np.flatnonzero(needs[at : at + size]).tolist():
                        places = _places(key[at + i])
                        for n in name[next_ : next_ + needs[at + i]]:
                            found.append(next((place + n for place in places if n is not None and place + n in known), None))
                        next_ += needs[at + i]
                    at += size
                src = np.repeat(np.arange(len(keys)), needs)
                lockfile = np.repeat(np.arange(len(sizes)), sizes)[src]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(lockfile)), keys.take(pa.array(src)), pa.array(found, pa.string()), named], names=["lockfile", "src", "dst", "name"])

    by = packages.where("lockfile is not null and key is not null").groupBy("lockfile").agg(F.collect_list(F.struct("key", "requires")).alias("packages"))
    return by.mapInArrow(run, "lockfile string, src string, dst string, name string")


def yarn_classic(files: DataFrame) -> DataFrame:
    """lockfile, entry, patterns (name@range), name, version and requires (name@range) of
    yarn.lock files of the first version."""
    rows = files.where((paths.file_name(F.col("path")) == "yarn.lock") & ~F.col("text").rlike("(?m)^__metadata:"))
    blocks = rows.select(F.col("path").alias("lockfile"), F.posexplode(F.split(F.regexp_replace("text", r"(?m)^\s*#.*$", ""), r"\n(?=[^\s])")).alias("entry", "block")).where(F.col("block").rlike(r"(?m)^[^\s].*:\s*$"))
    header = F.regexp_extract("block", r"(?m)^([^\s].*):\s*$", 1)
    patterns = F.transform(F.split(header, r"\s*,\s*"), lambda x: F.regexp_replace(x, '^"|"$', ""))
    section = F.regexp_extract_all(F.regexp_extract("block", r"\n  (?:dependencies):((?:\n    .*)*)", 1), F.lit(r'\n    ("?[^\s"]+"?) "?([^"\n]+)"?'), F.lit(0))
    needs = F.transform(section, lambda x: F.concat(F.regexp_replace(F.regexp_extract(x, r'\n    ("?[^\s"]+"?) ', 1), '"', ""), F.lit("@"), F.regexp_replace(F.regexp_extract(x, r'\n    "?[^\s"]+"? (.+)', 1), '"', "")))
    return blocks.select("lockfile", "entry", patterns.alias("patterns"), names.name_of_key(patterns[0]).alias("name"), F.regexp_extract("block", r'\n  version "([^"]+)"', 1).alias("version"), needs.alias("requires"))


def yarn_berry(files: DataFrame) -> DataFrame:
    """As ``yarn_classic``, of yarn.lock files of later versions: patterns name a protocol
    (name@npm:range), which a requirement may leave out."""
    rows = files.where((paths.file_name(F.col("path")) == "yarn.lock") & F.col("text").rlike("(?m)^__metadata:"))
    plain = F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*#.*$", ""), r"(?m)^\? (.+)\n:", "$1:")
    blocks = rows.select(F.col("path").alias("lockfile"), F.posexplode(F.split(plain, r"\n(?=[^\s])")).alias("entry", "block"))
    header = F.regexp_replace(F.regexp_extract("block", r"^\s*([^\s].*):\s*(?:\n|$)", 1), '^"|"$', "")
    patterns = F.split("header", r"\s*,\s*")
    section = F.regexp_extract("block", r"\n  dependencies:((?:\n    .*)*)", 1)
    entry = r'\n    "?([^"\s]+?)"?: "?([^"\n]+)"?'
    needs = F.transform(F.regexp_extract_all(section, F.lit(entry), F.lit(0)), lambda x: berry_pattern(F.regexp_extract(x, entry, 1), F.regexp_extract(x, entry, 2)))
    found = blocks.withColumn("header", header).where("header not in ('', '__metadata')")
    return found.select("lockfile", "entry", patterns.alias("patterns"), names.name_of_key(patterns[0]).alias("name"), F.regexp_extract("block", r'\n  version: "?([^"\n]+)"?', 1).alias("version"), needs.alias("requires"))


def berry_pattern(name: Column, constraint: Column) -> Column:
    """name@protocol:range; npm where no protocol is said."""
    return F.concat(name, F.lit("@"), F.when(constraint.rlike(r"^[a-z][a-z+.-]*:"), constraint).otherwise(F.concat(F.lit("npm:"), constraint)))


def yarn_edges(packages: DataFrame) -> DataFrame:
    """lockfile, src and dst (entries; dst null if unresolved) and pattern."""
    need = packages.select("lockfile", F.col("entry").alias("src"), F.explode("requires").alias("pattern"))
    known = packages.select("lockfile", F.col("entry").alias("dst"), F.explode("patterns").alias("pattern"))
    return need.join(shuffled(known), ["lockfile", "pattern"], "left").select("lockfile", "src", "dst", "pattern")


def toml_packages(files: DataFrame) -> DataFrame:
    """lockfile, name, version, source and requires of Cargo.lock, poetry.lock and uv.lock;
    a file that does not parse gives no rows."""
    wanted = paths.file_name(F.col("path")).isin("Cargo.lock", "poetry.lock", "uv.lock")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tomllib

        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = tomllib.loads(text or "").get("package") or []
                except tomllib.TOMLDecodeError:
                    continue
                for p in found:
                    needs = p.get("dependencies") or []
                    needs = list(needs) if isinstance(needs, dict) else [x if isinstance(x, str) else x.get("name") for x in needs]
                    source = p.get("source")
                    rows.append({"lockfile": path, "name": p.get("name"), "version": p.get("version"), "source": source if isinstance(source, str) else next(iter(source), None) if isinstance(source, dict) else None, "requires": [x for x in needs if x]})
            schema = pa.schema([(c, pa.string()) for c in ("lockfile", "name", "version", "source")] + [("requires", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(wanted).select("path", "text").mapInArrow(run, "lockfile string, name string, version string, source string, requires array<string>")


def name_edges(packages: DataFrame) -> DataFrame:
    """lockfile, src, dst (names; dst null if unresolved) and forked, where a name is
    locked in more than one version.  'name version' picks a version; a bare name must
    be unique."""
    need = packages.select("lockfile", F.col("name").alias("src"), F.explode("requires").alias("need"))
    need = need.withColumns({"dst": F.split("need", " ")[0], "wanted": F.try_element_at(F.split("need", " "), F.lit(2))})
    by = packages.groupBy("lockfile", F.col("name").alias("dst")).agg(F.count_distinct("version").alias("versions"), F.collect_set("version").alias("all"))
    both = need.join(shuffled(by), ["lockfile", "dst"], "left")
    good = F.col("versions").isNotNull() & (F.col("wanted").isNull() | F.array_contains("all", F.col("wanted")))
    return both.select("lockfile", "src", F.when(good, F.col("dst")).alias("dst"), (F.coalesce("versions", F.lit(0)) > 1).alias("forked"))


def nearest_lockfile(projects: DataFrame, files: DataFrame, preferred: list[str]) -> DataFrame:
    """project and lockfile: the nearest folder at or above with one; of several in it the
    first of ``preferred`` (file names)."""
    found = files.where(paths.is_lockfile(F.col("path"))).select("path", paths.directory(F.col("path")).alias("folder"), F.coalesce(F.array_position(paths.literal(preferred), paths.file_name(F.col("path"))), F.lit(0)).alias("place"))
    place = F.when(F.col("place") == 0, len(preferred) + 1).otherwise(F.col("place"))
    w = Window.partitionBy("folder").orderBy(place, "path")
    one = found.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("folder", F.col("path").alias("lockfile"))
    from factloom.operators.joins import nearest_ancestor

    return nearest_ancestor(shuffled(projects.select("project")), shuffled(one), "project", "folder").select("project", "lockfile")


def scoped_registries(files: DataFrame) -> DataFrame:
    """folder, scope and origin that .npmrc files bind; of repeated scopes in a file the
    last counts, and one that is no plain http(s) address has a null origin."""
    each = files.where(paths.file_name(F.col("path")) == ".npmrc").select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "t"))
    bound = r"^\s*(@[^:\s=]+):registry\s*=\s*[\"']?([^\"'\s]*)[\"']?\s*$"
    rows = each.select("path", "line", F.regexp_extract("t", bound, 1).alias("scope"), F.regexp_extract("t", bound, 2).alias("url")).where("scope != ''")
    last = rows.groupBy("path", "scope").agg(F.max_by("url", "line").alias("url"))
    return last.select(paths.directory(F.col("path")).alias("folder"), "scope", names.registry_origin(F.col("url")).alias("origin"))

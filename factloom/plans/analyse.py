"""From the files of a repository to findings: the whole analysis as one plan.

files(path, text) are read to declared dependencies, locked graphs and references;
references are attributed to the nearest project that declares their package; the rules
judge each dependency.  Every step is a DataFrame, so any number of repositories' files
can lie in one table if paths are prefixed by repository.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names, paths, tables
from factloom.operators import graph, joins, rules
from factloom.sources import aliases, configs, lockfiles, manifests, references

JS = "javascript-typescript"
NUL = "\u0000"
USAGE = ["dependency", "file", "form", "via", "type_only", "removed_in_pr"]


def allowlisted(ecosystem: Column, name: Column, extra: dict | None = None) -> Column:
    """Whether a tool uses the package without an import; Python names in normal form."""
    out = F.lit(False)
    for source in (tables.TOOLS, extra or {}):
        for e, lists in source.items():
            shown = names.python_name(name) if e == "python" else name
            hit = shown.isin(*lists.get("exact", [])) if lists.get("exact") else F.lit(False)
            for p in lists.get("prefixes", []):
                hit = hit | F.startswith(shown, F.lit(p))
            out = out | ((ecosystem == e) & hit)
    return out


def _usage(rows: DataFrame, name: str, via: str, form: str | None = None, types: str | None = None) -> DataFrame:
    return rows.select(F.col(name).alias("dependency"), F.col("path").alias("file"), (F.col(form) if form else F.lit("unknown")).alias("form"), F.lit(via).alias("via"), (F.col(types) if types else F.lit(False)).alias("type_only"), F.lit(False).alias("removed_in_pr"))


def javascript_usages(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports, attributed to the nearest project at or above that declares the package
    (itself or its @types), and commands of scripts and CI steps.  What an alias leads to a
    file of the repository is no package."""
    own = declared.where(F.col("ecosystem") == JS).select("project", "name").distinct()
    by_package = own.select("project", "name", F.coalesce(names.types_target(F.col("name")), "name").alias("package"))
    imports = graph.stored(references.javascript(files).where("package is not null"))
    found = imports.join(aliases.internal(imports, files), ["path", "specifier"], "left_anti").withColumn("folder", paths.directory(F.col("path")))
    roots = by_package.select("project", "package").distinct().withColumnRenamed("project", "owner")
    owned = joins.nearest_ancestor(found, roots, "folder", "owner", extra=["package"]).where("owner is not null")
    imported = owned.join(by_package.withColumnRenamed("project", "owner"), ["owner", "package"])
    bins = own.select("name").distinct().select("name", F.explode(F.array_union(_bins(F.col("name")), F.array(F.regexp_replace("name", "^@[^/]+/", ""), F.col("name")))).alias("command"))
    scripts = references.package_scripts(files).unionByName(references.workflow_steps(files).select("path", F.lit("run").alias("name"), "script"))
    run = references.commands(scripts).withColumnRenamed("name", "script_name").join(bins, "command").dropDuplicates(["path", "script_name", "name"])
    return _usage(imported, "name", "import", "form", "type_only").unionByName(_usage(run, "name", "script"))


def _bins(name: Column) -> Column:
    out = F.array().cast("array<string>")
    for package, commands in tables.BINS.items():
        out = F.when(name == package, F.array(*[F.lit(c) for c in commands])).otherwise(out)
    return out


def python_usages(files: DataFrame) -> DataFrame:
    spark = files.sparkSession
    known = spark.createDataFrame([(m, d) for m, all_ in tables.PYTHON_MODULES.items() for d in all_], "module string, distribution string")
    modules = F.regexp_extract("path", r"(?:^|/)([A-Za-z_]\w*)(?:/__init__\.py|\.py)$", 1)
    first = files.select(modules.alias("module")).where("module not in ('', 'setup', 'conftest', '__init__')").distinct()
    standard = spark.createDataFrame([(m,) for m in sorted(sys.stdlib_module_names)], "module string")
    found = references.python_distributions(references.python(files), known, first.unionByName(standard))
    return _usage(found, "distribution", "import", "form")


def go_usages(files: DataFrame, declared: DataFrame) -> DataFrame:
    own = declared.where("ecosystem = 'go'").select(F.col("name").alias("owner")).distinct()
    return _usage(joins.longest_prefix(references.go(files), own, "module", "owner").where("owner is not null"), "owner", "import")


def rust_usages(files: DataFrame, declared: DataFrame) -> DataFrame:
    own = declared.where("ecosystem = 'rust'").select("name", F.translate("name", "-", "_").alias("crate")).distinct()
    return _usage(references.rust(files).join(own, "crate"), "name", "import")


def locked_closure(files: DataFrame, declared: DataFrame, packages: DataFrame) -> DataFrame:
    """ecosystem, project, direct, member: names that each direct dependency of a project
    reaches in the lockfile that holds for it.  ``packages`` are those of install trees.

    A node is lockfile, name and key, so one closure serves all kinds of lockfiles.
    """
    installed = lambda key: names.name_in_modules(F.col(key))
    folder = paths.directory(F.col("lockfile"))
    below = lambda f, path: F.when(path.isin("", "."), f).when(f == ".", path).otherwise(F.concat(f, F.lit("/"), path))
    tree = lockfiles.npm_edges(packages).where("dst is not null")
    root = ~F.col("src").contains("node_modules/")
    steps = [tree.where(~root).select(node(installed("src"), "src").alias("src"), node(installed("dst"), "dst").alias("dst"))]
    starts = [tree.where(root).select(F.lit(JS).alias("ecosystem"), below(folder, F.col("src")).alias("project"), installed("dst").alias("direct"), node(installed("dst"), "dst").alias("src"))]

    pnpm = lockfiles.pnpm(files).where("dst is not null")
    importer = F.col("src").startswith("importer:")
    keyed = lambda key: node(names.name_of_key(F.col(key)), key)
    steps.append(pnpm.where(~importer).select(keyed("src").alias("src"), keyed("dst").alias("dst")))
    starts.append(pnpm.where(importer).select(F.lit(JS), below(folder, F.regexp_replace("src", "^importer:", "")), "name", keyed("dst")))

    yarn = graph.stored(lockfiles.yarn_classic(files).unionByName(lockfiles.yarn_berry(files)))
    named = yarn.select("lockfile", "entry", node(F.col("name"), "entry").alias("node"))
    at = lambda out, entry: graph.shuffled(named.select("lockfile", F.col("entry").alias(entry), F.col("node").alias(out)))
    steps.append(lockfiles.yarn_edges(yarn).where("dst is not null").join(at("_s", "src"), ["lockfile", "src"]).join(at("_d", "dst"), ["lockfile", "dst"]).select("_s", "_d"))
    own = declared.where(F.col("ecosystem") == JS).select("project", "name", "constraint").distinct()
    asked = own.withColumn("pattern", F.explode(F.array_distinct(F.array(F.concat("name", F.lit("@"), "constraint"), lockfiles.berry_pattern(F.col("name"), F.col("constraint"))))))
    patterns = yarn.select("lockfile", "entry", F.explode("patterns").alias("pattern"))
    of = lambda file: graph.shuffled(lockfiles.nearest_lockfile(declared.select("project").distinct(), files.where(paths.file_name(F.col("path")).isin(*file)), file).where("lockfile is not null"))
    starts.append(asked.join(of(["yarn.lock"]), "project").join(graph.shuffled(patterns), ["lockfile", "pattern"]).select(F.lit(JS), "project", "name", node(F.col("name"), "entry")))

    rust = F.col("lockfile").endswith("Cargo.lock")
    shown = lambda c: F.when(rust, F.col(c)).otherwise(names.python_name(F.col(c)))
    tables_ = lockfiles.name_edges(graph.stored(lockfiles.toml_packages(files))).where("dst is not null")
    steps.append(tables_.select(node(shown("src"), shown("src")).alias("src"), node(shown("dst"), shown("dst")).alias("dst")))
    for ecosystem, kinds in (("rust", ["Cargo.lock"]), ("python", ["uv.lock", "poetry.lock"])):
        mine = declared.where(F.col("ecosystem") == ecosystem).select("project", "name").distinct()
        starts.append(mine.join(of(kinds), "project").select(F.lit(ecosystem), "project", "name", node(F.col("name"), "name")))

    edges, heads = reduce(DataFrame.union, steps), graph.stored(reduce(DataFrame.union, starts).distinct())
    reach = graph.closure(edges, starts=heads.select("src").distinct())
    rows = heads.join(graph.shuffled(reach), "src").select("ecosystem", "project", "direct", F.split("dst", NUL)[1].alias("member"))
    return rows.where("direct != member").distinct()


def node(name: Column, key: str | Column) -> Column:
    return F.concat_ws(NUL, F.col("lockfile"), name, F.col(key).cast("string") if isinstance(key, str) else key)


def peers_of(packages: DataFrame, resolved: bool) -> DataFrame:
    """ecosystem, project, direct, member: peers that direct dependencies expect."""
    rows = lockfiles.npm_peers(packages).where(F.col("resolved") == resolved)
    return rows.select(F.lit(JS).alias("ecosystem"), paths.directory(F.col("lockfile")).alias("project"), "direct", "member")


def used(files: DataFrame, declared: DataFrame) -> DataFrame:
    """All usages of declared dependencies: imports, scripts, CI and configuration."""
    named = configs.usages(files, declared.where(F.col("ecosystem") == JS))
    return reduce(DataFrame.unionByName, [javascript_usages(files, declared), _usage(graph.stored(named), "name", "config"), python_usages(files), go_usages(files, declared), rust_usages(files, declared)])


def unread(files: DataFrame, declared: DataFrame) -> DataFrame:
    """ecosystem and project of the JavaScript projects of which, or of a project above
    which, something that may name packages was not read: configuration that is a program
    or YAML, imports of computed names, what scripts compute, and bases of compiler
    settings that are not there."""
    scripts = references.script_gaps(references.package_scripts(files))
    where = reduce(DataFrame.union, [configs.unread(files), references.javascript_gaps(files).select("path"), scripts.select("path"), aliases.broken(files).select("path")])
    own = declared.where(F.col("ecosystem") == JS).select("project").distinct()
    held = joins.nearest_ancestor(where.select(paths.directory(F.col("path")).alias("folder")).distinct(), own, "folder", "project").where("project is not null")
    above = own.select("project", F.explode(paths.ancestors(F.col("project"))).alias("at"))
    return above.join(held.select(F.col("project").alias("at")).distinct(), "at").select(F.lit(JS).alias("ecosystem"), "project").distinct()


def analysed(files: DataFrame, extra_tools: dict | None = None, base: DataFrame | None = None) -> DataFrame:
    """Findings of the repository (see ``rules.findings``).

    Only JavaScript also has its scripts, CI and configuration read, so only there can
    absence be told; elsewhere, and where something of a project went unread, a dependency
    without imports is noted for review.  With
    ``base``, the files before a pull request, usages that its head has no more count as
    removed.
    """
    spark = files.sparkSession
    # What is read is written once: every later step uses it, and the plans stay small.
    declared = graph.stored(manifests.declared(files))
    inside = lambda f: f.where(~paths.has_excluded_segment(F.col("path")))
    own = inside(files)
    usages = graph.stored(used(own, declared))
    if base is not None:
        gone = graph.stored(used(inside(base), declared)).join(usages.select("dependency", "file", "via"), ["dependency", "file", "via"], "left_anti")
        usages = usages.unionByName(gone.withColumn("removed_in_pr", F.lit(True)))
    ecosystems = spark.createDataFrame([(JS, True, True), ("python", True, False), ("rust", True, False), ("go", True, False)], "ecosystem string, usages_analysed boolean, references_analysed boolean")
    packages = graph.stored(reduce(DataFrame.unionByName, [lockfiles.npm_packages(own), lockfiles.npm_tree_packages(own), lockfiles.bun_packages(own)]))
    dependencies = declared.groupBy("ecosystem", "project", "name", "kind").agg(F.min("declared_in").alias("declared_in"), F.min("specifier_type").alias("specifier_type"))
    return rules.findings(dependencies, usages, locked_closure(own, declared, packages), peers_of(packages, True), peers_of(packages, False), ecosystems, allowlisted(F.col("ecosystem"), F.col("name"), extra_tools), paths.is_non_shipped(F.col("file")), pull_request=base is not None, gaps=graph.stored(unread(own, declared)))

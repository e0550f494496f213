"""Configuration of JavaScript tools: files(path, text) to the packages that it names.

Declarative files and keys of package.json are parsed by Spark to variants.  A setting is
a place in the document and the way in which its names stand for packages; documents nested
in others (overrides, environments, projects) are read like those around them.  Files that
are programs or YAML are not read; ``unread`` lists them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names, paths

# File names of each tool's declarative configuration, and its key in package.json.
FILES = {
    "eslint": [".eslintrc", ".eslintrc.json"],
    "babel": [".babelrc", ".babelrc.json", "babel.config.json"],
    "jest": ["jest.config.json"],
    "prettier": [".prettierrc", ".prettierrc.json"],
    "tsconfig": ["tsconfig.json", "jsconfig.json"],
    "stylelint": [".stylelintrc", ".stylelintrc.json"],
    "commitlint": [".commitlintrc", ".commitlintrc.json"],
    "postcss": [".postcssrc", ".postcssrc.json"],
}
KEYS = {"eslint": "eslintConfig", "babel": "babel", "jest": "jest", "prettier": "prettier", "stylelint": "stylelint", "commitlint": "commitlint", "postcss": "postcss"}
# Settings, and the prefix that a short name stands for ('' where a name is a
# package); keys of an object or its values are meant where that is said.
SETTINGS = {
    "eslint": [("extends", "eslint-config", "names"), ("plugins", "eslint-plugin", "names"), ("parser", "", "names"), ("settings['import/resolver']", "eslint-import-resolver", "names or keys")],
    "babel": [("presets", "babel-preset", "names"), ("plugins", "babel-plugin", "names")],
    "jest": [
        *[(k, "", "names") for k in ("preset", "resolver", "globalSetup", "globalTeardown", "dependencyExtractor", "testResultsProcessor", "testSequencer", "snapshotResolver", "runtime", "prettierPath", "setupFiles", "setupFilesAfterEnv", "snapshotSerializers", "reporters", "watchPlugins")],
        ("testEnvironment", "jest-environment", "names"), ("runner", "jest-runner", "names"), ("testRunner", "jest-runner", "names"), ("moduleNameMapper", "", "values"), ("transform", "", "values"),
    ],
    "prettier": [("plugins", "", "names")],
    "tsconfig": [("extends", "", "names"), ("compilerOptions.types", "@types", "names"), ("compilerOptions.jsxImportSource", "", "names")],
    "stylelint": [("extends", "stylelint-config", "names"), ("plugins", "stylelint-plugin", "names"), ("customSyntax", "", "names")],
    "commitlint": [("extends", "commitlint-config", "names"), ("plugins", "commitlint-plugin", "names")],
    "postcss": [("parser", "", "names"), ("syntax", "", "names"), ("stringifier", "", "names"), ("plugins", "", "names or keys")],
}
#: Where a document holds documents of its own kind, and how deep that is followed.
NESTED = {"eslint": [("overrides", "array")], "babel": [("env", "map"), ("overrides", "array")], "jest": [("projects", "array")], "prettier": [("overrides", "options")], "stylelint": [("overrides", "array")]}
DEPTH = 4
# Settings that jest reads of its whole run only, not of a project in it.
JEST_WHOLE_RUN = ("testResultsProcessor", "testSequencer", "reporters", "watchPlugins")
UNREAD = r"(?:^|/)(?:\.(?:eslint|babel|prettier|stylelint|commitlint|postcss|mocha|lintstaged)rc\.(?:ya?ml|[cm]?js|ts)|(?:eslint|babel|jest|vitest|vite|webpack|rollup|prettier|stylelint|commitlint|postcss|tailwind|next|nuxt|svelte|astro)\.config\.[cm]?[jt]s)$"


def plain_json(text: Column) -> Column:
    """JSON without the comments and trailing commas that configuration may hold."""
    # Unrolled and without a way back, as most of a text is strings.
    string = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    bare = F.regexp_replace(text, string + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1")
    return F.regexp_replace(bare, string + r"|,(\s*[}\]])", "$1$2")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _named(v: Column) -> Column:
    """Names in a variant: a string, or of a list the strings and the first string of lists."""
    text = lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    first = lambda x: F.try_variant_get(x, "$[0]", "variant")
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(text(x), text(first(x))))
    return F.when(_kind(v) == "ARRAY", F.filter(items, lambda x: x.isNotNull())).when(_kind(v) == "STRING", F.array(text(v)))


def _entries(v: Column, way: str) -> Column:
    table = F.when(_kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))
    if way == "values":
        return F.flatten(F.transform(F.map_values(table), _named))
    return _named(v) if way == "names" else F.coalesce(_named(v), F.map_keys(table))


# How tools complete a short name.  A form holds for names of its shape (with a
# scope, a name, or both) under its prefix, "*" for any that completes names; a name that
# begins with what is put before it is complete as it is.
FORMS = [
    # prefix, scope, shape, put before, the package
    ("@types", "", "name", "", "@types/{name}"),
    ("@types", "", "scope and name", "", "@types/{owner}__{name}"),
    ("*", "", "name", "{prefix}", "{prefix}-{name}"),
    ("*", "", "scope", "", "{scope}/{prefix}"),
    ("*", "", "scope and name", "{prefix}", "{scope}/{prefix}-{name}"),
    ("babel-preset", "@babel", "scope and name", "preset", "@babel/preset-{name}"),
    ("babel-plugin", "@babel", "scope and name", "plugin", "@babel/plugin-{name}"),
]


def _parts(spec: Column) -> tuple[Column, Column]:
    """The scope and the name that a specifier begins with, '' where it has none; both are
    '' for paths, addresses and placeholders."""
    s = F.trim(spec)
    outside = s.contains(":") | F.substring(s, 1, 1).isin(".", "/", "<")
    part = lambda pattern: F.when(outside, "").otherwise(F.regexp_extract(s, pattern, 1))
    return part("^(@[^/]+)"), part("^(?:@[^/]+/)?([^/@][^/]*)")


def package_of(spec: Column) -> Column:
    """The package that a specifier lies in; null for paths, addresses and placeholders."""
    scope, name = _parts(spec)
    return F.when(name != "", F.concat_ws("/", F.nullif(scope, F.lit("")), name))


def candidates(name: Column, prefix: Column) -> Column:
    """The packages that a tool takes a name for: itself, and what ``FORMS`` make of it."""
    whole = F.regexp_replace(name, "^module:", "")
    scope, base = _parts(whole)
    shape = F.concat_ws(" and ", F.when(scope != "", "scope"), F.when(base != "", "name"))
    values = {"scope": scope, "owner": F.substring(scope, F.lit(2), F.length(scope)), "name": base, "prefix": prefix}

    def filled(form: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", form)  # text and values in turn
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces)])

    made = []
    for of, of_scope, of_shape, before, package in FORMS:
        holds = (shape == of_shape) & (~prefix.isin("", "@types") if of == "*" else prefix == of)
        holds = holds & (scope == of_scope) if of_scope else holds
        complete = F.startswith(base, filled(before)) if before else F.lit(False)
        made.append(F.when(holds & ~complete, filled(package)))
    return F.array_distinct(F.array_compact(F.array(package_of(whole), *made)))


def documents(files: DataFrame) -> DataFrame:
    """path, tool, v and level: every configuration document, and those nested in it up
    to ``DEPTH`` levels down."""
    named = paths.file_name(F.col("path"))
    wanted = [n for all_ in FILES.values() for n in all_]
    parsed = files.where(named.isin("package.json", *wanted)).select("path", named.alias("file"), F.try_parse_json(plain_json(F.col("text"))).alias("v")).where("v is not null")
    tool = F.lit(None).cast("string")
    for name, all_ in FILES.items():
        tool = F.when(F.col("file").isin(*all_), name).otherwise(tool)
    whole = parsed.where("file != 'package.json'").select("path", tool.alias("tool"), "v")
    inside = parsed.where("file = 'package.json'").select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("tool"), F.try_variant_get("v", f"$.{key}", "variant").alias("v")) for k, key in KEYS.items()])).alias("d"))
    level = whole.unionByName(inside.select("path", "d.*").where("v is not null")).withColumn("level", F.lit(0))
    held = F.array().cast("array<variant>")
    for name, places in NESTED.items():
        items = []
        for place, way in places:
            at = F.try_variant_get("v", f"$.{place}", "variant")
            table = F.map_values(F.try_variant_get(at, "$", "map<string,variant>")) if way == "map" else F.try_variant_get(at, "$", "array<variant>")
            table = F.transform(table, lambda x: F.try_variant_get(x, "$.options", "variant")) if way == "options" else table
            items.append(F.coalesce(table, F.array().cast("array<variant>")))
        held = F.when(F.col("tool") == name, F.concat(*items)).otherwise(held)
    found = level
    for _ in range(DEPTH):
        level = level.select("path", "tool", F.explode(held).alias("v"), (F.col("level") + 1).alias("level")).where("v is not null")
        found = found.unionByName(level)
    return found


def references(files: DataFrame) -> DataFrame:
    """path, setting, name and packages (candidates) of what configuration names."""
    docs = documents(files)
    read = []
    for tool, settings in SETTINGS.items():
        whole = (F.col("tool") == tool) & (_kind(F.col("v")) == "OBJECT")
        for place, prefix, way in settings:
            of = whole & (F.col("level") == 0) if tool == "jest" and place in JEST_WHOLE_RUN else whole
            read.append((f"{tool} {place}", prefix, F.when(of, _entries(F.try_variant_get("v", f"$.{place}", "variant"), way))))
    read.append(("prettier shared config", "", F.when(F.col("tool") == "prettier", F.when(_kind(F.col("v")) == "STRING", F.array(F.try_variant_get("v", "$", "string"))))))
    plugins = F.transform(F.try_variant_get("v", "$.compilerOptions.plugins", "array<variant>"), lambda x: F.try_variant_get(x, "$.name", "string"))
    read.append(("tsconfig plugins", "", F.when(F.col("tool") == "tsconfig", plugins)))
    each = docs.select("path", F.explode(F.array(*[F.struct(F.lit(setting).alias("setting"), F.lit(prefix).alias("prefix"), found.alias("names")) for setting, prefix, found in read])).alias("r"))
    rows = each.select("path", "r.setting", "r.prefix", F.explode("r.names").alias("name")).where("name is not null")
    # "plugin:<name>/<config>" names the plugin before the last slash.
    plugin = (F.col("setting") == "eslint extends") & F.col("name").startswith("plugin:")
    meant = F.when(plugin, F.regexp_replace("name", r"^plugin:|/[^/]*$", "")).otherwise(F.col("name"))
    prefix = F.when(plugin, "eslint-plugin").otherwise(F.col("prefix"))
    default = (F.col("setting") == "jest testEnvironment") & (F.col("name") == "node") | F.col("setting").isin(*[f"jest {k}" for k in ("setupFiles", "setupFilesAfterEnv", "snapshotSerializers", "reporters", "watchPlugins")]) & (F.col("name") == "default")
    builtin = (F.col("setting") == "eslint extends") & F.col("name").startswith("eslint:")
    return rows.where(~default & ~builtin).withColumns({"meant": meant, "prefix": prefix}).select("path", "setting", "name", candidates(F.col("meant"), F.col("prefix")).alias("packages")).where("size(packages) > 0").distinct()


def unread(files: DataFrame) -> DataFrame:
    """path of configuration that is a program or YAML, and not read."""
    return files.where(F.col("path").rlike(UNREAD)).select("path")


def usages(files: DataFrame, declared: DataFrame) -> DataFrame:
    """name, path and setting: references attributed to the nearest project at or above
    that declares a candidate (itself or its @types)."""
    from factloom.operators.joins import nearest_ancestor

    each = references(files).select("path", "setting", F.explode("packages").alias("package")).distinct().withColumn("folder", paths.directory(F.col("path")))
    own = declared.select("project", "name").distinct().select("project", "name", F.coalesce(names.types_target(F.col("name")), "name").alias("package"))
    both = own.select("project", "name", F.explode(F.array_distinct(F.array("package", "name"))).alias("package")).distinct()
    owned = nearest_ancestor(each, both.select(F.col("project").alias("owner"), "package").distinct(), "folder", "owner", extra=["package"]).where("owner is not null")
    return owned.join(both.withColumnRenamed("project", "owner"), ["owner", "package"]).select("name", "path", "setting").distinct()

"""Repositories written from the generated tables (manifests, lockfiles, sources, diffs,
webhooks) and read back by the library.  The SQL states what must be read, from the tables
themselves, so a file is only the way between the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import changes, rules
from factloom.plans import analyse
from factloom.plans.queries import long, query, t
from factloom.sources import configs, diffs, files, lockfiles, manifests, references
from factloom.streaming import events


def _text(*parts) -> Column:
    """Parts end to end; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(rows: DataFrame, keys: list[str], order: list[str], line: str = "line") -> DataFrame:
    """keys and text: the lines of each key in order; null lines are left out."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(*keys).agg(F.array_join(F.filter(F.transform(packed, lambda x: x[line]), lambda x: x.isNotNull()), "\n").alias("text"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers, whose nation is cut into blocks of their keys: a file for each block has
    a size of its own, however large the table."""
    return t(spark, sf, "supplier").withColumn("s_nationkey", _text(F.col("s_nationkey"), "-", F.floor(F.col("s_suppkey") / 100)))


def _in_blocks(sql: str) -> str:
    """``sql`` over suppliers in such blocks."""
    blocks = "WITH blocks AS (SELECT * REPLACE (s_nationkey || '-' || s_suppkey // 100 AS s_nationkey) FROM supplier)"
    rest = sql.replace("FROM supplier", "FROM blocks").replace("JOIN supplier", "JOIN blocks")
    return f"{blocks}, {rest.removeprefix('WITH ')}" if rest.startswith("WITH ") else f"{blocks}\n{rest}"


# Manifests


@query("""SELECT 'c' || o_custkey AS project, 'pkg-' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN '^1.2.3' WHEN 'O' THEN 'workspace:*' ELSE 'git+https://github.com/a/b.git' END AS spec,
CASE left(o_orderpriority, 1) WHEN '1' THEN 'runtime' WHEN '2' THEN 'dev' WHEN '3' THEN 'peer' ELSE 'optional' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'registry' WHEN 'O' THEN 'workspace' ELSE 'git' END AS specifier FROM orders""")
def manifest_json(spark: SparkSession, sf: str) -> DataFrame:
    """A package.json for each customer, which depends on the orders."""
    first = F.substring("o_orderpriority", 1, 1)
    section = F.when(first == "1", "dependencies").when(first == "2", "devDependencies").when(first == "3", "peerDependencies").otherwise("optionalDependencies")
    spec = F.when(F.col("o_orderstatus") == "F", "^1.2.3").when(F.col("o_orderstatus") == "O", "workspace:*").otherwise("git+https://github.com/a/b.git")
    each = t(spark, sf, "orders").select("o_custkey", section.alias("section"), F.struct(_text("pkg-", F.col("o_orderkey")), spec).alias("e"))
    one = each.groupBy("o_custkey", "section").agg(F.map_from_entries(F.collect_list("e")).alias("m")).groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "m")))).alias("text"))
    found = manifests.package_json(one.select(_text("c", F.col("o_custkey"), "/package.json").alias("path"), "text"))
    return found.select("project", "name", F.col("constraint").alias("spec"), "kind", F.col("specifier_type").alias("specifier"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey, l_partkey AS k FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS line FROM l)
SELECT 's' || l_suppkey AS project, 'part-' || k AS name, CASE k % 3 WHEN 0 THEN '>=1.' || k % 7 ELSE '==2.' || k % 5 END AS spec, line FROM n WHERE k % 3 <> 1""")
def manifest_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """A requirements file for each supplier: extras, markers, comments and line numbers."""
    k = F.col("l_partkey")
    line = F.when(k % 3 == 0, _text("Part_", k, "[extra]>=1.", k % 7, " ; python_version >= '3.8'")).when(k % 3 == 1, _text("# part ", k)).otherwise(_text("part.", k, "==2.", k % 5, "  # note"))
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().withColumn("line", line)
    one = _lines(rows, ["l_suppkey"], ["l_partkey"]).select(_text("s", F.col("l_suppkey"), "/requirements.txt").alias("path"), "text")
    return manifests.requirements(one).select("project", "name", F.col("constraint").alias("spec"), long("declared_line").alias("line"))


@query(_in_blocks("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)
SELECT 'n' || s_nationkey AS project, 'github.com/acme/s' || s_suppkey AS name, 'v1.' || s_suppkey % 9 || '.0' AS spec, 5 + r AS line, CASE WHEN s_suppkey % 5 = 0 THEN 'file' ELSE 'registry' END AS specifier FROM n WHERE s_suppkey % 4 <> 0"""))
def manifest_go(spark: SparkSession, sf: str) -> DataFrame:
    """A go.mod for each nation: a block of requirements, indirect ones, replacements."""
    k = F.col("s_suppkey")
    need = F.concat(_text("\tgithub.com/acme/s", k, " v1.", k % 9, ".0"), F.when(k % 4 == 0, " // indirect").otherwise(""))
    rows = _suppliers(spark, sf).withColumns({"line": need, "swap": F.when(k % 5 == 0, _text("replace github.com/acme/s", k, " => ../s", k))})
    both = _lines(rows, ["s_nationkey"], ["s_suppkey"]).join(_lines(rows, ["s_nationkey"], ["s_suppkey"], "swap").withColumnRenamed("text", "swaps"), "s_nationkey")
    one = both.select(_text("n", F.col("s_nationkey"), "/go.mod").alias("path"), _text("module example.com/n", F.col("s_nationkey"), "\n\ngo 1.21\n\nrequire (\n", F.col("text"), "\n)\n", F.col("swaps")).alias("text"))
    return manifests.go_mod(one).select("project", "name", F.col("constraint").alias("spec"), long("declared_line").alias("line"), F.col("specifier_type").alias("specifier"))


@query(_in_blocks("""SELECT 'n' || s_nationkey AS project, 's' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN '1.' || s_suppkey % 9 END AS spec, CASE WHEN s_suppkey % 3 = 2 THEN 'optional' ELSE 'runtime' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'file' ELSE 'git' END AS specifier FROM supplier
UNION ALL SELECT 'n' || s_nationkey, 'real' || s_suppkey, '2', 'dev', 'registry' FROM supplier
UNION ALL SELECT 'p' || s_nationkey, 'lib-s' || s_suppkey, '>=' || s_suppkey % 4, CASE WHEN s_suppkey % 2 = 0 THEN 'runtime' ELSE 'build' END, 'registry' FROM supplier"""))
def manifest_toml(spark: SparkSession, sf: str) -> DataFrame:
    """A Cargo.toml (paths, git, optional, renamed) and a pyproject.toml for each nation."""
    k = F.col("s_suppkey")
    entry = F.when(k % 3 == 0, _text("s", k, ' = "1.', k % 9, '"')).when(k % 3 == 1, _text("s", k, ' = { path = "../s', k, '" }')).otherwise(_text("s", k, ' = { git = "https://x/y", optional = true }'))
    quoted = _text('"lib_S', k, ">=", k % 4, '",')
    rows = _suppliers(spark, sf).withColumns({"line": entry, "dev": _text("d", k, ' = { package = "real', k, '", version = "2" }'), "run": F.when(k % 2 == 0, quoted), "build": F.when(k % 2 == 1, quoted)})
    made = rows.select("s_nationkey").distinct()
    for name in ("line", "dev", "run", "build"):
        made = made.join(_lines(rows, ["s_nationkey"], ["s_suppkey"], name).withColumnRenamed("text", name), "s_nationkey")
    cargo = made.select(_text("n", F.col("s_nationkey"), "/Cargo.toml").alias("path"), _text("[dependencies]\n", F.col("line"), "\n[dev-dependencies]\n", F.col("dev")).alias("text"))
    project = made.select(_text("p", F.col("s_nationkey"), "/pyproject.toml").alias("path"), _text("[project]\ndependencies = [\n", F.col("run"), "\n]\n[build-system]\nrequires = [\n", F.col("build"), "\n]").alias("text"))
    return manifests.toml(cargo.unionByName(project)).select("project", "name", F.col("constraint").alias("spec"), "kind", F.col("specifier_type").alias("specifier"))


# Lockfiles


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_suppkey) AS s, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'o' || o || '/package-lock.json' AS lockfile, '' AS src, 'node_modules/p' || p AS dst, 'p' || p AS name FROM l
UNION ALL SELECT 'o' || o || '/package-lock.json', 'node_modules/p' || p, CASE WHEN n = 1 THEN 'node_modules/p' || p || '/node_modules/s' || s WHEN s % 2 = 0 THEN 'node_modules/s' || s END, 's' || s FROM l""")
def lock_npm_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A package-lock.json for each order: nested copies hide those above; some are missing."""
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("s"), F.min("l_linenumber").alias("n"))
    no = F.create_map().cast("map<string,string>")
    part, maker = _text("p", F.col("p")), _text("s", F.col("s"))
    entry = lambda key, needs: F.struct(key.alias("key"), F.struct(F.lit("1.0.0").alias("version"), needs.alias("dependencies")).alias("p"))
    made = F.array(
        entry(_text("node_modules/", part), F.create_map(maker, F.lit("*"))),
        F.when(F.col("n") == 1, entry(_text("node_modules/", part, "/node_modules/", maker), no)),
        F.when(F.col("s") % 2 == 0, entry(_text("node_modules/", maker), no)),
    )
    one = rows.groupBy("o").agg(F.flatten(F.collect_list(made)).alias("all"), F.map_from_entries(F.collect_list(F.struct(part, F.lit("*")))).alias("root"))
    keys = F.transform(F.array_distinct(F.transform(F.filter("all", lambda x: x.isNotNull()), lambda x: F.struct(x["key"], F.to_json(x["p"]).alias("p")))), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["p"]))
    text = _text('{"packages":{"":', F.to_json(F.struct(F.col("root").alias("dependencies"))), ",", F.array_join(keys, ","), "}}")
    found = lockfiles.npm_packages(one.select(_text("o", F.col("o"), "/package-lock.json").alias("path"), text.alias("text")))
    return lockfiles.npm_edges(found)


@query("""SELECT 'n' || a.s_nationkey || '/Cargo.lock' AS lockfile, 's' || a.s_suppkey AS src, 's' || b.s_suppkey AS dst, coalesce(b.s_suppkey % 10 = 0, false) AS forked
FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 25 AND b.s_nationkey = a.s_nationkey""")
def lock_cargo_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A Cargo.lock for each nation; every tenth crate is locked in two versions."""
    k = F.col("s_suppkey")
    block = F.concat(_text('[[package]]\nname = "s', k, '"\nversion = "1.0.0"\ndependencies = ["s', k + 25, '"]\n'), F.when(k % 10 == 0, _text('[[package]]\nname = "s', k, '"\nversion = "2.0.0"\n')).otherwise(""))
    one = _lines(t(spark, sf, "supplier").withColumn("line", block), ["s_nationkey"], ["s_suppkey"]).select(_text("n", F.col("s_nationkey"), "/Cargo.lock").alias("path"), "text")
    return lockfiles.name_edges(lockfiles.toml_packages(one))


@query("""SELECT 'n' || a.s_nationkey || '/yarn.lock' AS lockfile, '@acme/s' || a.s_suppkey AS name, '1.' || a.s_suppkey || '.0' AS version, 's' || (a.s_suppkey + 25) || '@^1.0.0' AS pattern, b.s_suppkey IS NOT NULL AS resolved
FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 25 AND b.s_nationkey = a.s_nationkey""")
def lock_yarn_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A yarn.lock of the first version for each nation; an entry answers to two patterns."""
    k = F.col("s_suppkey")
    block = _text('\n"@acme/s', k, '@^1.0.0", s', k, '@^1.0.0:\n  version "1.', k, '.0"\n  dependencies:\n    s', k + 25, ' "^1.0.0"')
    one = _lines(t(spark, sf, "supplier").withColumn("line", block), ["s_nationkey"], ["s_suppkey"]).select(_text("n", F.col("s_nationkey"), "/yarn.lock").alias("path"), _text("# yarn lockfile v1\n", F.col("text"), "\n").alias("text"))
    found = lockfiles.yarn_classic(one)
    names = found.select("lockfile", F.col("entry").alias("src"), "name", "version")
    return lockfiles.yarn_edges(found).join(names, ["lockfile", "src"]).select("lockfile", "name", "version", "pattern", F.col("dst").isNotNull().alias("resolved"))


# Diffs and changes


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 'del' WHEN 'A' THEN 'add' ELSE 'context' END AS type, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END AS sign, 'p' || l_partkey AS text FROM lineitem),
c AS (SELECT *, count_if(type <> 'add') OVER w AS o, count_if(type <> 'del') OVER w AS a FROM l WINDOW w AS (PARTITION BY id ORDER BY n, sign || text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, 'f' || id || '.txt' AS path, type, CASE WHEN type <> 'add' THEN CAST(9 + o AS BIGINT) END AS old_line, CASE WHEN type <> 'del' THEN CAST(19 + a AS BIGINT) END AS new_line, text FROM c""")
def diff_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A unified diff for each order, whose lines are added, removed or context."""
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    rows = t(spark, sf, "lineitem").withColumn("line", F.concat(sign, _text("p", F.col("l_partkey"))))
    o = F.col("l_orderkey")
    body = _lines(rows, ["l_orderkey"], ["l_linenumber"])
    one = body.select(o.alias("id"), _text("diff --git a/f", o, ".txt b/f", o, ".txt\n--- a/f", o, ".txt\n+++ b/f", o, ".txt\n@@ -10,7 +20,7 @@\n", F.col("text")).alias("text"))
    return diffs.diff_lines(one).select("id", "path", "type", long("old_line").alias("old_line"), long("new_line").alias("new_line"), "text")


@query("""SELECT DISTINCT 'c' || o_custkey || '/app/package.json' AS path FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def uncovered_manifest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changed manifests of customers without a changed lockfile in a folder above."""
    path = F.when(F.col("o_orderstatus") == "F", _text("c", F.col("o_custkey"), "/app/package.json")).when(F.col("o_orderstatus") == "P", _text("c", F.col("o_custkey"), "/package-lock.json"))
    return changes.uncovered_manifests(t(spark, sf, "orders").select(path.alias("path")).where("path is not null").distinct())


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_name || '/' || p_partkey) AS place FROM part""")
def ranked_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each path in the order of all."""
    rows = t(spark, sf, "part").select("p_partkey", _text(F.col("p_name"), "/", F.col("p_partkey")).alias("path"))
    return files.with_rank(rows, "path").select("p_partkey", long("_rank").alias("place"))


# References


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT 'o' || o || '/src/a.ts' AS path, CASE f WHEN 'A' THEN 'p' || p || '/sub' WHEN 'R' THEN '@acme/p' || p || '/x' ELSE './p' || p END AS specifier, CASE f WHEN 'A' THEN 'static' WHEN 'R' THEN 'require' ELSE 'dynamic' END AS form,
f = 'A' AND p % 2 = 0 AS type_only, CASE f WHEN 'A' THEN 'p' || p WHEN 'R' THEN '@acme/p' || p END AS package FROM l""")
def references_javascript(spark: SparkSession, sf: str) -> DataFrame:
    """A TypeScript file for each order: imports of types and values, require, dynamic."""
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("f"))
    p = F.col("l_partkey")
    word = F.when(p % 2 == 0, "import type ").otherwise("import ")
    line = F.when(F.col("f") == "A", F.concat(word, _text("{ x", p, " } from 'p", p, "/sub';"))).when(F.col("f") == "R", _text("const y = require('@acme/p", p, "/x'); // require('no')")).otherwise(_text("const z = await import('./p", p, "');"))
    one = _lines(rows.withColumn("line", line), ["l_orderkey"], ["l_partkey"]).select(_text("o", F.col("l_orderkey"), "/src/a.ts").alias("path"), "text")
    return references.javascript(one).select("path", "specifier", "form", "type_only", "package")


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT 'o' || o || '/a.py' AS path, CASE f WHEN 'A' THEN 'p' || p || '.sub' WHEN 'R' THEN 'p' || p || '.x' ELSE 'p' || p END AS module, CASE f WHEN 'N' THEN 'dynamic' ELSE 'static' END AS form, f = 'R' AS conditional FROM l""")
def references_python(spark: SparkSession, sf: str) -> DataFrame:
    """A Python file for each order: imports, indented ones, dynamic ones, none in strings."""
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("f"))
    p = F.col("l_partkey")
    line = F.when(F.col("f") == "A", _text("import p", p, ".sub as q  # import no")).when(F.col("f") == "R", _text("try:\n    from p", p, ".x import y\nexcept ImportError:\n    pass")).otherwise(_text("importlib.import_module('p", p, "')"))
    one = _lines(rows.withColumn("line", line), ["l_orderkey"], ["l_partkey"]).select(_text("o", F.col("l_orderkey"), "/a.py").alias("path"), _text('"""\nimport no\n"""\n', F.col("text"), "\n").alias("text"))
    return references.python(one)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT 'o' || o || '/a.go' AS path, 'github.com/acme/p' || p || '/sub' AS name, 'go' AS language FROM l UNION ALL SELECT 'o' || o || '/a.rs', 'p' || p, 'rust' FROM l""")
def references_go_rust(spark: SparkSession, sf: str) -> DataFrame:
    """A Go and a Rust file for each order."""
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    go = _lines(rows.withColumn("line", _text('\tq "github.com/acme/p', p, '/sub" // "no"')), ["l_orderkey"], ["l_partkey"]).select(_text("o", o, "/a.go").alias("path"), _text("package a\n\nimport (\n", F.col("text"), "\n)\n").alias("text"))
    rust = _lines(rows.withColumn("line", _text("use p", p, "::Thing;\n// use no::Thing;\nfn f() { std::mem::drop(self::g(\"no::x\")) }")), ["l_orderkey"], ["l_partkey"]).select(_text("o", o, "/a.rs").alias("path"), "text")
    return references.go(go).select("path", F.col("module").alias("name"), F.lit("go").alias("language")).unionByName(references.rust(rust).select("path", F.col("crate").alias("name"), F.lit("rust").alias("language")))


@query("""SELECT event_id, unnest(['tool' || user_id, 'run-' || event_type, 'tee']) AS command FROM events""")
def script_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Command words of scripts, after assignments and wrappers."""
    script = _text("NODE_ENV=x npx tool", F.col("user_id"), " --fast && cross-env A=1 run-", F.col("event_type"), " | tee log")
    rows = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.lit("build").alias("name"), script.alias("script"))
    return references.commands(rows).select(F.col("path").cast("bigint").alias("event_id"), "command")


# Verdicts


@query("""WITH u AS (SELECT o_custkey, count_if(o_orderstatus <> 'P') AS used, count_if(o_orderstatus = 'P') AS removed, coalesce(bool_and(o_orderpriority = '1-URGENT') FILTER (WHERE o_orderstatus <> 'P'), false) AS types, coalesce(bool_and(o_orderstatus = 'F') FILTER (WHERE o_orderstatus <> 'P'), false) AS tests FROM orders GROUP BY 1),
r AS (SELECT 'c' || c_custkey AS dependency, CASE WHEN c_nationkey = 0 THEN NULL WHEN coalesce(used, 0) = 0 AND coalesce(removed, 0) > 0 THEN 'removed-last-usage' WHEN coalesce(used, 0) = 0 THEN 'unused' WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN types THEN 'type-only' WHEN tests THEN 'should-be-dev' END AS rule FROM customer LEFT JOIN u ON o_custkey = c_custkey)
SELECT dependency, CASE WHEN rule = 'removed-last-usage' THEN 'unused' ELSE rule END AS kind, rule, CASE WHEN rule IN ('unused', 'removed-last-usage') THEN 'medium' ELSE 'low' END AS severity, 'medium' AS confidence FROM r WHERE rule IS NOT NULL""")
def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as dependencies, orders as their usages: in tests, shipped, or removed."""
    fixed = {"ecosystem": F.lit("javascript-typescript"), "project": F.lit("."), "declared_in": F.lit("package.json")}
    declared = t(spark, sf, "customer").withColumns(fixed).withColumns({"name": _text("c", F.col("c_custkey")), "kind": F.when(F.col("c_mktsegment") == "BUILDING", "dev").otherwise("runtime"), "specifier_type": F.when(F.col("c_nationkey") == 0, "workspace").otherwise("registry")})
    status = F.col("o_orderstatus")
    usages = t(spark, sf, "orders").select(_text("c", F.col("o_custkey")).alias("dependency"), F.when(status == "F", "test/a.js").otherwise("src/a.js").alias("file"), F.lit("static").alias("form"), F.lit("import").alias("via"), (F.col("o_orderpriority") == "1-URGENT").alias("type_only"), (status == "P").alias("removed_in_pr"))
    none = spark.createDataFrame([], "ecosystem string, project string, direct string, member string")
    known = spark.createDataFrame([("javascript-typescript", True, True)], "ecosystem string, usages_analysed boolean, references_analysed boolean")
    found = rules.findings(declared.select(*fixed, "name", "kind", "specifier_type"), usages, none, none, none, known, F.lit(False), F.col("file").startswith("test/"), pull_request=True)
    return found.select("dependency", "kind", "rule", "severity", "confidence")


ANALYSED_SQL = _in_blocks("""SELECT 'n' || s_nationkey AS project, 's' || s_suppkey AS dependency, CASE s_suppkey % 8 WHEN 4 THEN 'unused' WHEN 2 THEN 'should-be-dev' WHEN 6 THEN 'should-be-dev' ELSE 'type-only' END AS kind, CASE s_suppkey % 8 WHEN 4 THEN 'medium' ELSE 'low' END AS severity
FROM supplier WHERE s_suppkey % 8 IN (2, 3, 4, 6, 7)""")


@query(ANALYSED_SQL)
def analysed_repositories(spark: SparkSession, sf: str) -> DataFrame:
    """The whole analysis: a project for each nation, whose suppliers are imported by what
    is shipped, by tests, as types, run by a script, or not at all."""
    k = F.col("s_suppkey")
    rows = _suppliers(spark, sf)
    run = F.when(k % 8 == 0, F.struct(_text("b", k).alias("n"), _text("s", k, " build").alias("s")))
    depend = F.map_from_entries(F.collect_list(F.struct(_text("s", k), F.lit("^1.0.0"))))
    made = rows.groupBy("s_nationkey").agg(F.to_json(F.struct(depend.alias("dependencies"), F.map_from_entries(F.collect_list(run)).alias("scripts"))).alias("text"))
    manifest = made.select(_text("n", F.col("s_nationkey"), "/package.json").alias("path"), "text")
    line = F.when(k % 4 == 3, _text("import type { T } from 's", k, "';")).otherwise(_text("import x from 's", k, "';"))
    used = rows.withColumns({"line": line, "file": F.when(k % 4 == 2, "test/a.test.js").otherwise("src/a.js")}).where(k % 4 != 0)
    sources = _lines(used, ["s_nationkey", "file"], ["s_suppkey"]).select(_text("n", F.col("s_nationkey"), "/", F.col("file")).alias("path"), "text")
    return analyse.analysed(manifest.unionByName(sources)).select("project", "dependency", "kind", "severity")


@query("""SELECT event_id AS delivery, event_type IN ('signup', 'purchase') AS analyse, CASE event_type WHEN 'view' THEN 'event issues is not analysed' WHEN 'click' THEN 'pull_request.closed is not analysed' WHEN 'error' THEN 'branch deletion'
WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'no dependency manifest, lockfile, scope config changed' END END AS reason FROM events WHERE event_type <> 'purchase' OR user_id % 2 <> 0
UNION ALL SELECT event_id, false, 'no dependency manifest, lockfile, scope config changed' FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0""")
def webhook_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as webhook deliveries: pull requests, pushes of files, deletions."""
    kind, user = F.col("event_type"), F.col("user_id")
    name = F.when(kind == "view", "issues").when(kind.isin("signup", "click"), "pull_request").otherwise("push")
    nobody = '"installation":{"id":1},"repository":{"id":7,"name":"r","default_branch":"main","owner":{"login":"o"}}'
    pull = F.concat(F.lit('{"action":"'), F.when(kind == "signup", "opened").otherwise("closed"), _text('","number":', F.col("event_id"), ',"pull_request":{"head":{"sha":"h', F.col("event_id"), '"},"base":{"sha":"b"}},', nobody, "}"))
    touched = F.when(user % 2 == 0, "docs/readme.md").otherwise("app/package.json")
    push = F.concat(F.lit('{"ref":"refs/heads/main","before":"aa","after":"'), _text("h", F.col("event_id")), F.lit('","deleted":'), F.when(kind == "error", "true").otherwise("false"), F.lit(',"commits":[{"added":[],"modified":["'), touched, F.lit('"]}],' + nobody + "}"))
    deliveries = t(spark, sf, "events").select(F.col("event_id").alias("delivery"), name.alias("event"), F.when(name == "push", push).otherwise(pull).alias("payload"))
    changed = spark.createDataFrame([], "key string, files array<string>, complete boolean")
    return events.decided(deliveries, changed).select("delivery", "analyse", "reason")


_V = "l_linenumber * 10000 + CAST(l_quantity AS BIGINT) * 100 + l_partkey % 5"
_R = "(l_suppkey % 7) * 10000 + (l_suppkey % 50) * 100"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN (CASE l_suppkey % 6 WHEN 0 THEN {_V} >= {_R} WHEN 1 THEN {_V} < {_R} + 100 WHEN 2 THEN {_V} >= {_R} + 100 WHEN 3 THEN {_V} < {_R}
WHEN 4 THEN {_V} >= {_R} AND {_V} < {_R} + 100 ELSE {_V} >= {_R} AND l_linenumber = l_suppkey % 7 AND (l_suppkey % 7 > 0 OR CAST(l_quantity AS BIGINT) = l_suppkey % 50) END) THEN 'yes' ELSE 'no' END AS fits FROM lineitem""")
def version_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Whole versions against ranges of two parts, which stand for all that begin so."""
    from factloom.functions import text

    s = F.col("l_suppkey")
    sign = F.element_at(F.array(*[F.lit(x) for x in (">=", "<=", ">", "<", "~", "^")]), (s % 6 + 1).cast("int"))
    version = _text(F.col("l_linenumber"), ".", F.col("l_quantity").cast("bigint"), ".", F.col("l_partkey") % 5)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.satisfies(version, F.concat(sign, _text(s % 7, ".", s % 50))).alias("fits"))


# Configuration, more lockfiles, pull requests


@query(_in_blocks("""SELECT 'n' || s_nationkey || '/.eslintrc.json' AS path, 'eslint plugins' AS setting, '@s' || s_suppkey AS name, '@s' || s_suppkey || '/eslint-plugin' AS packages FROM supplier
UNION ALL SELECT 'n' || s_nationkey || '/.eslintrc.json', 'eslint extends', 'plugin:s' || s_suppkey || '/all', 's' || s_suppkey || ',eslint-plugin-s' || s_suppkey FROM supplier
UNION ALL SELECT 'n' || s_nationkey || '/.eslintrc.json', 'eslint extends', 'base' || s_suppkey, 'base' || s_suppkey || ',eslint-config-base' || s_suppkey FROM supplier
UNION ALL SELECT 'n' || s_nationkey || '/package.json', 'babel presets', '@babel/s' || s_suppkey, '@babel/s' || s_suppkey || ',@babel/babel-preset-s' || s_suppkey || ',@babel/preset-s' || s_suppkey FROM supplier
UNION ALL SELECT 'n' || s_nationkey || '/tsconfig.json', 'tsconfig compilerOptions.types', 's' || s_suppkey || '/globals', 's' || s_suppkey || ',@types/s' || s_suppkey FROM supplier"""))
def config_references(spark: SparkSession, sf: str) -> DataFrame:
    """Tools' configuration for each nation: comments, overrides, keys of package.json."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    all_ = lambda c: F.to_json(F.collect_list(c))
    made = _suppliers(spark, sf).groupBy(n).agg(all_(_text("@s", k)).alias("plugins"), all_(_text("plugin:s", k, "/all")).alias("extends"), all_(_text("base", k)).alias("bases"), F.to_json(F.collect_list(F.array(_text("@babel/s", k)))).alias("presets"), all_(_text("s", k, "/globals")).alias("types"))
    one = lambda name, text: made.select(_text("n", n, name).alias("path"), text.alias("text"))
    lint = _text('{ // "plugins": ["no"]\n"plugins": ', F.col("plugins"), ', "overrides": [{"files": "x", "extends": ', F.col("extends"), ', "overrides": [{"extends": ', F.col("bases"), "}],}]}")
    babel = _text('{"babel": {"env": {"test": {"presets": ', F.col("presets"), "}}}}")
    types = _text('{"compilerOptions": {"types": ', F.col("types"), "/* all */}}")
    found = configs.references(one("/.eslintrc.json", lint).unionByName(one("/package.json", babel)).unionByName(one("/tsconfig.json", types)))
    return found.select("path", "setting", "name", F.array_join("packages", ",").alias("packages"))


@query(_in_blocks("""WITH e AS (SELECT a.s_nationkey AS n, a.s_suppkey AS s, b.s_suppkey AS d FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 25 AND b.s_nationkey = a.s_nationkey)
SELECT 'n' || n || '/pnpm-lock.yaml' AS lockfile, 'importer:apps/web' AS src, 's' || s AS name, s % 2 = 0 AS dev, CASE WHEN s % 5 <> 0 THEN 's' || s || '@1.0.0(react@18.2.0)' END AS dst FROM e
UNION ALL SELECT 'n' || n || '/pnpm-lock.yaml', 's' || s || '@1.0.0(react@18.2.0)', 's' || (s + 25), false, CASE WHEN d IS NOT NULL THEN 's' || d || '@1.0.0(react@18.2.0)' END FROM e"""))
def lock_pnpm_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A pnpm-lock.yaml for each nation: importers, links, peers in keys."""
    k = F.col("s_suppkey")
    locked = "1.0.0(react@18.2.0)"
    where = F.when(k % 5 == 0, "link:../lib").otherwise(locked)
    entry = F.concat(_text("      s", k, ":\n        specifier: ^1.0.0\n        version: "), where)
    rows = _suppliers(spark, sf).withColumns({"run": F.when(k % 2 == 1, entry), "dev": F.when(k % 2 == 0, entry), "snap": _text("  s", k, f"@{locked}:\n    dependencies:\n      s", k + 25, f": {locked}\n      # end")})
    made = rows.select("s_nationkey").distinct()
    for name in ("run", "dev", "snap"):
        made = made.join(_lines(rows, ["s_nationkey"], ["s_suppkey"], name).withColumnRenamed("text", name), "s_nationkey")
    text = _text("lockfileVersion: '9.0'\n\nimporters:\n\n  apps/web:\n    dependencies:\n", F.col("run"), "\n    devDependencies:\n", F.col("dev"), "\n\nsnapshots:\n\n", F.col("snap"), "\n")
    return lockfiles.pnpm(made.select(_text("n", F.col("s_nationkey"), "/pnpm-lock.yaml").alias("path"), text.alias("text"))).drop("reference")


@query("""SELECT 'n' || a.s_nationkey || '/yarn.lock' AS lockfile, '@acme/s' || a.s_suppkey AS name, '1.' || a.s_suppkey || '.0' AS version, 's' || (a.s_suppkey + 25) || CASE WHEN a.s_suppkey % 2 = 0 THEN '@npm:^1.0.0' ELSE '@workspace:^' END AS pattern, a.s_suppkey % 2 = 0 AND b.s_suppkey IS NOT NULL AS resolved
FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 25 AND b.s_nationkey = a.s_nationkey""")
def lock_berry_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A yarn.lock of the later versions for each nation; half of the requirements are of
    workspaces, which no entry answers to."""
    k = F.col("s_suppkey")
    spec = F.when(k % 2 == 0, "^1.0.0").otherwise('"workspace:^"')
    block = F.concat(_text('\n"@acme/s', k, '@npm:^1.0.0, s', k, '@npm:^1.0.0":\n  version: 1.', k, '.0\n  resolution: "@acme/s', k, '@npm:1"\n  dependencies:\n    s', k + 25, ": "), spec, F.lit('\n  peerDependencies:\n    no: "*"'))
    one = _lines(t(spark, sf, "supplier").withColumn("line", block), ["s_nationkey"], ["s_suppkey"]).select(_text("n", F.col("s_nationkey"), "/yarn.lock").alias("path"), _text("__metadata:\n  version: 8\n", F.col("text"), "\n").alias("text"))
    found = lockfiles.yarn_berry(one)
    names = found.select("lockfile", F.col("entry").alias("src"), "name", "version")
    return lockfiles.yarn_edges(found).join(names, ["lockfile", "src"]).select("lockfile", "name", "version", "pattern", F.col("dst").isNotNull().alias("resolved"))


_INSTALLED_SQL = """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_suppkey) AS s, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'o' || o || '/{file}' AS lockfile, '' AS src, 'node_modules/p' || p AS dst, 'p' || p AS name FROM l
UNION ALL SELECT 'o' || o || '/{file}', 'node_modules/p' || p, CASE WHEN n = 1 THEN 'node_modules/p' || p || '/node_modules/s' || s WHEN s % 2 = 0 THEN 'node_modules/s' || s END, 's' || s FROM l"""


def _installed(spark: SparkSession, sf: str) -> DataFrame:
    """An order's parts, each of which requires its maker: o, p and s (names), nested (the
    part holds a copy of its own) and top (the root holds one)."""
    # An order's lines come together once, for its parts and then for its files.
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey", "l_suppkey", "l_linenumber").repartition("o")
    rows = lines.groupBy("o", "l_partkey").agg(F.min("l_suppkey").alias("k"), F.min("l_linenumber").alias("n"))
    return rows.select("o", _text("p", F.col("l_partkey")).alias("p"), _text("s", F.col("k")).alias("s"), (F.col("n") == 1).alias("nested"), (F.col("k") % 2 == 0).alias("top"))


@query(_INSTALLED_SQL.format(file="bun.lock"))
def lock_bun_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A bun.lock for each order: nested copies, missing ones, trailing commas."""
    p, s = F.col("p"), F.col("s")
    part = _text('"', p, '": ["', p, '@1.0.0", "", {"dependencies": {"', s, '": "*"}}, "x"],\n')
    inner = F.when(F.col("nested"), _text('"', p, "/", s, '": ["', s, '@1.0.0", "", {}, "x"],\n')).otherwise("")
    outer = F.when(F.col("top"), _text('"', s, '": ["', s, '@2.0.0", "", {}, "x"],\n'))
    one = _installed(spark, sf).groupBy("o").agg(F.array_join(F.collect_list(F.concat(part, inner)), "").alias("own"), F.array_join(F.collect_set(outer), "").alias("tops"), F.to_json(F.map_from_entries(F.collect_list(F.struct(p, F.lit("*"))))).alias("root"))
    text = _text('{"workspaces": {"": {"dependencies": ', F.col("root"), '},},\n"packages": { // all\n', F.col("own"), F.col("tops"), "}}")
    return lockfiles.npm_edges(lockfiles.bun_packages(one.select(_text("o", F.col("o"), "/bun.lock").alias("path"), text.alias("text"))))


@query(_INSTALLED_SQL.format(file="package-lock.json"))
def lock_npm_tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A package-lock.json of nested packages for each order, with its package.json."""
    p, s = F.col("p"), F.col("s")
    inner = F.when(F.col("nested"), _text(',"dependencies":{"', s, '":{"version":"1.0.0"}}')).otherwise("")
    part = F.concat(_text('"', p, '":{"version":"1.0.0","requires":{"', s, '":"*"}'), inner, F.lit("}"))
    outer = F.when(F.col("top"), _text('"', s, '":{"version":"2.0.0"}'))
    one = _installed(spark, sf).groupBy("o").agg(F.array_join(F.array_union(F.collect_list(part), F.collect_set(outer)), ",").alias("all"), F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(p, F.lit("*")))).alias("dependencies"))).alias("root"))
    lock = F.struct(_text("o", F.col("o"), "/package-lock.json").alias("path"), _text('{"lockfileVersion":1,"dependencies":{', F.col("all"), "}}").alias("text"))
    both = one.select(F.explode(F.array(lock, F.struct(_text("o", F.col("o"), "/package.json").alias("path"), F.col("root").alias("text")))).alias("f"))
    return lockfiles.npm_edges(lockfiles.npm_tree_packages(both.select("f.*")))


@query("""SELECT 'c' || c_custkey AS folder, '@n' || c_nationkey AS scope, CASE WHEN c_custkey % 3 <> 0 THEN 'https://npm' || c_custkey || '.example' END AS origin FROM customer""")
def scoped_registries(spark: SparkSession, sf: str) -> DataFrame:
    """An .npmrc for each customer: a scope bound twice, of which the last counts."""
    k, scope = F.col("c_custkey"), _text("@n", F.col("c_nationkey"))
    url = F.when(k % 3 != 0, _text("https://NPM", k, ".example/r/")).otherwise(_text("https://u:p@npm", k, ".example/"))
    text = _text("registry=https://registry.npmjs.org\n", scope, ":registry=https://old.example\n; note\n", scope, ":registry = ", url, "\n//x/:_authToken=t\n")
    return lockfiles.scoped_registries(t(spark, sf, "customer").select(_text("c", k, "/.npmrc").alias("path"), text.alias("text")))


@query(_in_blocks("SELECT 'n' || s_nationkey || '/Pipfile.lock' AS lockfile, 'lib-s' || s_suppkey AS name, '1.' || s_suppkey AS version, s_suppkey % 2 = 0 AS dev FROM supplier"))
def lock_pipfile(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    entry = F.struct(_text("Lib_S", k), F.struct(_text("==1.", k).alias("version"), F.array(F.lit("sha256:0")).alias("hashes")))
    side = lambda odd: F.map_from_entries(F.collect_list(F.when(k % 2 == odd, entry)))
    made = _suppliers(spark, sf).groupBy("s_nationkey").agg(F.to_json(F.struct(side(1).alias("default"), side(0).alias("develop"))).alias("text"))
    return lockfiles.pipfile_packages(made.select(_text("n", F.col("s_nationkey"), "/Pipfile.lock").alias("path"), "text"))


@query("""SELECT 'n' || s_nationkey AS project, 's' || s_suppkey AS dependency, CASE s_suppkey % 4 WHEN 0 THEN 'unused' WHEN 1 THEN 'removed-last-usage' ELSE 'unverified-no-imports' END AS rule, CASE WHEN s_suppkey % 4 = 3 THEN 'host' END AS host
FROM supplier WHERE s_suppkey % 4 IN (0, 1, 3)""")
def analysed_pull_request(spark: SparkSession, sf: str) -> DataFrame:
    """Projects of a pull request: suppliers never used, used only before it, named by a
    tool's configuration, or expected beside another package."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = t(spark, sf, "supplier")
    made = rows.groupBy(n).agg(F.to_json(F.collect_list(F.when(k % 4 == 2, _text("s", k)))).alias("plugins"))
    one = lambda name, text: made.select(_text("n", n, name).alias("path"), text.alias("text"))
    peers = F.map_from_entries(F.collect_list(F.when(k % 4 == 3, F.struct(_text("s", k), F.lit("*")))))
    locks = rows.groupBy(n).agg(F.to_json(peers).alias("p"))
    lock = locks.select(_text("n", n, "/package-lock.json").alias("path"), _text('{"packages":{"":{"dependencies":{"host":"*"}},"node_modules/host":{"version":"1.0.0","peerDependencies":', F.col("p"), "}}}").alias("text"))
    whole = rows.groupBy(n).agg(F.to_json(F.struct(F.map_concat(F.create_map(F.lit("host"), F.lit("*")), F.map_from_entries(F.collect_list(F.struct(_text("s", k), F.lit("*"))))).alias("dependencies"))).alias("text"))
    manifest = whole.select(_text("n", n, "/package.json").alias("path"), "text")
    lint = one("/.stylelintrc", _text('{"plugins": ', F.col("plugins"), "}"))
    kept = rows.select(n).distinct().select(_text("n", n, "/src/a.js").alias("path"), F.lit("import h from 'host';").alias("text"))
    before = _lines(rows.where(k % 4 == 1).withColumn("line", _text("import x from 's", k, "';")), ["s_nationkey"], ["s_suppkey"]).select(_text("n", n, "/src/b.js").alias("path"), "text")
    head = manifest.unionByName(lock).unionByName(lint).unionByName(kept)
    return analyse.analysed(head, base=head.unionByName(before)).select("project", "dependency", "rule", "host")

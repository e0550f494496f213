"""Queries of what needs several files at once: aliases, unread configuration, workspaces,
markers, features and locked closures.  Every project is one of the tables' keys that grow
with them, so no file is more than a few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import markers
from factloom.operators import graph
from factloom.plans import analyse
from factloom.plans.queries import query, t
from factloom.plans.repository import _lines, _text
from factloom.sources import aliases, lockfiles, manifests, pythons, references, workspaces


def _file(rows: DataFrame, path, text) -> DataFrame:
    return rows.select(path.alias("path"), text.alias("text"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("""WITH o AS (SELECT 'c' || o_custkey AS c, o_orderkey AS k, o_custkey % 2 = 0 AS even, CASE o_orderstatus WHEN 'F' THEN '@app/o' WHEN 'O' THEN 'utils/o' ELSE '@app/util-o' END AS head FROM orders)
SELECT c || '/src/main.ts' AS path, head || k AS specifier, CASE head WHEN '@app/o' THEN c || '/src/lib/o' || k || '.ts' WHEN 'utils/o' THEN c || '/src/utils/o' || k || '/index.tsx' ELSE c || '/shared/o' || k || '.d.ts' END AS file
FROM o WHERE CASE head WHEN '@app/o' THEN k % 2 = 0 WHEN 'utils/o' THEN k % 3 = 0 ELSE k % 5 <> 0 END""")
def aliased_imports(spark: SparkSession, sf: str) -> DataFrame:
    """A project for each customer: keys inherited from a base (which extends back), a
    baseUrl of its own or inherited, targets that are there or not, and a longer key."""
    o = t(spark, sf, "orders")
    k, c, status = F.col("o_orderkey"), _text("c", F.col("o_custkey")), F.col("o_orderstatus")
    own = o.select("o_custkey").distinct()
    even = F.col("o_custkey") % 2 == 0
    config = _file(own, F.concat(c, F.lit("/tsconfig.json")), F.when(even, '{"extends": "./config/base", "compilerOptions": {"baseUrl": "./src",}}').otherwise('{"extends": ["./config/base.json"] /* no more */}'))
    keys = '"@app/*": ["lib/*", "old/*"], "@app/util-*": ["../shared/*"]'
    rest = '{"extends": "../tsconfig.json", "compilerOptions": {"baseUrl": "../src", "paths": {'
    # With a key that takes all, what it leads to is the same as below baseUrl.
    base = _file(own, F.concat(c, F.lit("/config/base.json")), F.when(even, rest + keys + "}}}").otherwise(rest + '"*": ["*", "missing/*"], ' + keys + "}}}"))
    head = F.when(status == "F", "@app/o").when(status == "O", "utils/o").otherwise("@app/util-o")
    main = _lines(o.withColumn("line", F.concat(F.lit("import x from '"), head, k.cast("string"), F.lit("';"))), ["o_custkey"], ["o_orderkey"]).select(F.concat(c, F.lit("/src/main.ts")).alias("path"), "text")
    there = F.when(status == "F", F.when(k % 2 == 0, _text(c, "/src/lib/o", k, ".ts"))).when(status == "O", F.when(k % 3 == 0, _text(c, "/src/utils/o", k, "/index.tsx"))).otherwise(F.when(k % 5 != 0, _text(c, "/shared/o", k, ".d.ts")))
    files = _all([config, base, main, _file(o, there, F.lit("export {}")).where("path is not null")])
    return aliases.internal(references.javascript(files), files)


@query("""SELECT 's' || s_suppkey AS project, 'lost' || s_suppkey AS dependency, CASE WHEN s_suppkey % 5 = 0 THEN 'unused' ELSE 'info' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 'unused' ELSE 'unverified-no-imports' END AS rule FROM supplier
UNION ALL SELECT 's' || s_suppkey, 'lib' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'unused' ELSE 'info' END, CASE WHEN s_suppkey % 5 = 0 THEN 'unused' ELSE 'unverified-no-imports' END FROM supplier WHERE s_suppkey % 5 <> 4""")
def held_back_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A project for each supplier that uses nothing it declares; where configuration is a
    program or YAML, an import is computed or a base is missing, that cannot be told.  An
    alias that shadows a declared package is no use of it."""
    k = F.col("s_suppkey")
    rows = t(spark, sf, "supplier").select("s_suppkey")
    p = _text("s", k)
    case = k % 5
    manifest = _file(rows, F.concat(p, F.lit("/package.json")), _text('{"dependencies": {"lost', k, '": "1", "lib', k, '": "1"}}'))
    odd = _file(rows, F.concat(p, F.when(case == 1, "/.eslintrc.cjs").when(case == 2, "/src/b.js").when(case == 3, "/tsconfig.json").when(case == 4, "/.prettierrc.yaml").otherwise("/docs.md")), F.when(case == 2, "require(name)").when(case == 3, '{"extends": "./gone"}').otherwise("x"))
    config = _file(rows.where(case == 0), F.concat(p, F.lit("/tsconfig.json")), _text('{"compilerOptions": {"paths": {"lib', k, '": ["./src/lib"]}}}'))
    use = F.when(case.isin(0, 4), _text("import lib from 'lib", k, "';")).otherwise("")
    source = _file(rows, F.concat(p, F.lit("/src/a.ts")), use)
    lib = _file(rows, F.concat(p, F.lit("/src/lib.ts")), F.lit(""))
    return analyse.analysed(_all([manifest, odd, config, source, lib])).select("project", "dependency", "kind", "rule")


@query("""WITH o AS (SELECT o_orderkey AS k, 'c' || o_custkey AS root, CASE o_orderstatus WHEN 'F' THEN 'packages/p' || o_orderkey WHEN 'O' THEN 'apps/' || left(o_orderpriority, 1) || '/a' || o_orderkey ELSE 'packages/.p' || o_orderkey END AS folder, o_custkey % 3 AS kind, o_orderstatus AS s FROM orders)
SELECT root, root || '/' || folder AS member, CASE WHEN kind = 0 THEN 'pnpm-workspace.yaml' ELSE 'package.json' END AS source,
CASE WHEN kind = 2 THEN 'unknown' WHEN s = 'F' AND NOT (kind = 0 AND k % 10 = 7) THEN 'member' WHEN s = 'O' AND kind = 0 AND folder NOT LIKE 'apps/1/%' THEN 'member' ELSE 'nonmember' END AS status FROM o""")
def workspace_members(spark: SparkSession, sf: str) -> DataFrame:
    """A workspace for each customer: pnpm's list with exclusions before what they exclude,
    package.json's two forms, hidden folders, and globs that are not understood."""
    o = t(spark, sf, "orders")
    k, c, status, kind = F.col("o_orderkey"), _text("c", F.col("o_custkey")), F.col("o_orderstatus"), F.col("o_custkey") % 3
    own = o.select("o_custkey").distinct()
    yaml = "packages:\n  - '!apps/1/**'  # not these\n  # none\n  - packages/*\n  - \"apps/**\"\n  - '!packages/p*7'\nother: x\n"
    root = _file(own, F.concat(c, F.when(kind == 0, "/pnpm-workspace.yaml").otherwise("/package.json")), F.when(kind == 0, yaml).when(kind == 1, '{"workspaces": ["./packages/*/",]}').otherwise('{"workspaces": {"packages": ["packages/{a,b}"]}}'))
    folder = F.when(status == "F", _text("/packages/p", k)).when(status == "O", F.concat(F.lit("/apps/"), F.substring("o_orderpriority", 1, 1), _text("/a", k))).otherwise(_text("/packages/.p", k))
    members = _file(o, F.concat(c, folder, F.lit("/package.json")), F.lit("{}"))
    installed = _file(o, F.concat(c, folder, F.lit("/node_modules/x/package.json")), F.lit("{}"))
    return workspaces.javascript_members(_all([root, members, installed]))


@query("""WITH s AS (SELECT s_suppkey AS k, 'w' || s_suppkey AS root FROM supplier)
SELECT root || '/crates/a1' AS member, 'serde' AS key, 'serde_' || k AS name, '1.' || k AS constraint FROM s UNION ALL SELECT root || '/crates/a1', 'gone', NULL, NULL FROM s
UNION ALL SELECT root || '/deep/x', 'serde', 'serde_' || k, '1.' || k FROM s WHERE k % 2 = 0 UNION ALL SELECT root || '/far/z', 'serde', 'serde_' || k, '1.' || k FROM s WHERE k % 2 = 0""")
def cargo_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """A Cargo workspace for each supplier: a class in a glob, an excluded crate, a crate
    that only a path leads to (over another, where the supplier is even) and a pointer."""
    k = F.col("s_suppkey")
    rows = t(spark, sf, "supplier").select("s_suppkey")
    at = lambda folder: _text("w", k, folder + "/Cargo.toml")
    takes = "serde = { workspace = true }\n"
    root = _file(rows, at(""), _text('[workspace]\nmembers = ["crates/[a-c]?", "none/*"]\nexclude = ["crates/b1"]\n[workspace.dependencies]\nserde = { version = "1.', k, '", package = "serde_', k, '" }\n'))
    first = _file(rows, at("/crates/a1"), F.concat(F.lit('[package]\nname = "a1"\n[dependencies]\n' + takes + "gone.workspace = true\n"), F.when(k % 2 == 0, 'x = { path = "../../deep/x" }\n').otherwise("")))
    others = [_file(rows, at(folder), F.lit('[package]\nname = "n"\n[dependencies]\n' + takes)) for folder in ("/crates/b1", "/crates/d1", "/crates/a1b")]
    deep = _file(rows, at("/deep/x"), F.lit('[package]\nname = "x"\n[target."cfg(unix)".build-dependencies]\nz = { path = "../../far/z" }\n' + takes))
    far = _file(rows, at("/far/z"), F.lit('[package]\nname = "z"\nworkspace = "../.."\n[dev-dependencies]\nx = { path = "../../deep/x" }\n' + takes))
    return workspaces.inherited_dependencies(_all([root, first, *others, deep, far]))


@query("""WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS crate FROM supplier)
SELECT crate, 'tls' AS key, unnest(CASE WHEN k % 2 = 0 THEN ['secure', 'net', 'default'] ELSE ['secure', 'net'] END) AS feature FROM s
UNION ALL SELECT crate, 'json', unnest(['json', 'net', 'api', 'ring'] || CASE WHEN k % 2 = 0 THEN ['default'] ELSE [] END) FROM s UNION ALL SELECT crate, 'weak', 'weak' FROM s UNION ALL SELECT crate, 'log', unnest(['api', 'ring']) FROM s
UNION ALL SELECT crate, 'alone', NULL FROM s""")
def feature_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A crate for each supplier: dep:, features of dependencies, weak ones, features named
    as a dependency or not, and a ring of features."""
    k = F.col("s_suppkey")
    optional = "".join(f'{key} = {{ version = "1", optional = true }}\n' for key in ("tls", "json", "weak", "log", "alone"))
    features = '[features]\nsecure = ["dep:tls", "weak?/std"]\nnet = ["secure", "json"]\napi = ["log/std", "json", "ring"]\nring = ["api"]\nalone = []\nlog = []\nempty = ["std"]\n'
    text = F.concat(F.lit('[package]\nname = "x"\n[dependencies]\n' + optional + features), F.when(k % 2 == 0, 'default = ["net"]\n').otherwise(""))
    return workspaces.feature_gates(workspaces.features(_file(t(spark, sf, "supplier"), _text("s", k, "/Cargo.toml"), text)))


@query("""SELECT 'p' || k AS project, CASE WHEN k % 9 IN (4, 6) THEN 'unparsed' WHEN k % 9 = 8 THEN 'absent' ELSE 'declared' END AS status,
CASE k % 9 WHEN 0 THEN '3.' || k % 13 || '.0' WHEN 1 THEN '3.' || k % 13 || '.0' WHEN 2 THEN '2.7.0' WHEN 3 THEN '3.' || k % 13 || '.0' WHEN 5 THEN '3.' || (k % 13 + 1) || '.0' WHEN 7 THEN '3.' || k % 13 || '.4' END AS version,
CASE WHEN k % 9 NOT IN (4, 6, 8) THEN k % 9 = 3 END AS exclusive, CASE WHEN k % 9 IN (1, 5) THEN 'setup.cfg' WHEN k % 9 = 7 THEN 'poetry python' WHEN k % 9 <> 8 THEN 'requires-python' END AS place FROM (SELECT p_partkey AS k FROM part)""")
def python_floors(spark: SparkSession, sf: str) -> DataFrame:
    """A project for each part: bounds, alternatives, exclusions and wildcards in
    pyproject.toml, poetry's table, setup.cfg, and a setup.py that computes its own."""
    k = F.col("p_partkey")
    n = k % 13
    spec = F.when(k % 9 == 0, _text(">=3.", n, ", <4, >=3.0")).when(k % 9 == 2, _text("^3.", n, " || >=2.7")).when(k % 9 == 3, _text(">3.", n, ",>=3.", n)).when(k % 9 == 4, _text(">=3.", n, ", !=3.", n)).when(k % 9 == 6, _text(">=3.", n, ", <3.", n))
    cfg = F.when(k % 9 == 1, _text("==3.", n, ".*")).when(k % 9 == 5, _text("~=3.", n + 1, ".0"))
    rows = t(spark, sf, "part").select("p_partkey").withColumns({"spec": spec, "cfg": cfg})
    path = lambda name: _text("p", k, "/" + name)
    files = [
        _file(rows.where("spec is not null"), path("pyproject.toml"), _text('[project]\nname = "x"\nrequires-python = "', F.col("spec"), '"\n')),
        _file(rows.where("cfg is not null"), path("setup.cfg"), _text("[metadata]\npython_requires = >=9\n[options]\nzip_safe = no\npython_requires = ", F.col("cfg"), "\n[x]\n")),
        _file(rows.where("cfg is not null"), path("setup.py"), F.lit("setup(python_requires=FLOOR)")),
        _file(rows.where(k % 9 == 7), path("pyproject.toml"), _text('[tool.poetry.dependencies]\npython = {version = "~3.', n, '.4"}\n')),
        _file(rows.where(k % 9 == 8), path("pyproject.toml"), F.lit("[project]\n")),
    ]
    return pythons.floors(_all(files)).select("project", "status", "version", "exclusive", "place")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'signup' THEN true WHEN 'click' THEN user_id % 2 = 0 ELSE false END AS valid FROM events""")
def marker_syntax(spark: SparkSession, sf: str) -> DataFrame:
    """A marker for each event: joined, nested and negated ones, and what is none."""
    kind, user = F.col("event_type"), F.col("user_id")
    depth = (user % 64).cast("int") + 1
    text = F.when(kind == "view", _text("python_version >= '3.", user, "' and (extra not  in \"a b\" or sys.platform != 'x')")).when(kind == "signup", F.concat(F.repeat(F.lit("("), depth), F.lit("os_name=='nt'"), F.repeat(F.lit(")"), depth)))
    text = text.when(kind == "click", F.concat(F.lit("'x' in os_name or extra == 'and'"), F.when(user % 2 == 0, "").otherwise(" and"))).when(kind == "error", _text("python_version > 3.", user)).otherwise("(extra == 'a'")
    return t(spark, sf, "events").select("event_id", markers.is_marker(text).alias("valid"))


@query("""WITH s AS (SELECT 's' || s_suppkey AS project, s_suppkey AS k FROM supplier),
m AS (SELECT project, unnest(['a', 'b', 'c']) AS extra, 'lib-c' AS name FROM s UNION ALL SELECT project, unnest(['a', 'b']), 'lib-b' FROM s UNION ALL SELECT project, unnest(CASE WHEN k % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END), 'lib-a' || k FROM s)
SELECT project, extra, name FROM m UNION ALL SELECT project, 'none', NULL FROM s""")
def extras_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A project for each supplier whose extras ask for its other extras, in a ring where
    the supplier is even."""
    k = F.col("s_suppkey")
    text = F.concat(
        _text('[project]\nname = "My_Pkg', k, '"\n[project.optional-dependencies]\na = ["lib_a', k, '>1", "my.pkg', k, "[b]\"]\nb = [\"Lib.B ; extra == 'x'\", \"my-pkg", k, '[ C, none ]"'),
        F.when(k % 2 == 0, _text(', "my_pkg', k, '[a]"')).otherwise(""), F.lit(']\nC = ["lib-c"]\nnone = []\n'),
    )
    return pythons.extras(_file(t(spark, sf, "supplier"), _text("s", k, "/pyproject.toml"), text))


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey % 3 AS p, CASE l_returnflag WHEN 'A' THEN 'os_name == ''nt''' WHEN 'R' THEN 'python_version < ''3''' END AS m FROM lineitem),
g AS (SELECT o, p, bool_or(m IS NULL) AS plain, list_sort(list_distinct(list(m))) AS m FROM l GROUP BY 1, 2)
SELECT 'o' || o AS project, 'part-' || p AS name, CASE WHEN plain THEN NULL WHEN len(m) = 1 THEN m[1] ELSE '(' || m[1] || ') or (' || m[2] || ')' END AS marker FROM g""")
def merged_markers(spark: SparkSession, sf: str) -> DataFrame:
    """A project for each order whose lines declare the same few parts again and again,
    under one condition, another or none."""
    flag = F.col("l_returnflag")
    line = F.concat(_text('"part.', F.col("l_partkey") % 3, " >= 1"), F.when(flag == "A", " ; os_name == 'nt'").when(flag == "R", "; python_version < '3' ").otherwise(""), F.lit('",'))
    # Reading a file costs far more than moving it, so tasks are as many as the session's
    # shuffle partitions; by their bytes they would be few, and not of even number.
    lines = t(spark, sf, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    one = _lines(lines.withColumn("line", line), ["l_orderkey"], ["l_linenumber"])
    files = _file(one, _text("o", F.col("l_orderkey"), "/pyproject.toml"), _text("[project]\ndependencies = [\n", F.col("text"), "\n]\n"))
    return pythons.conditions(files).select("project", "name", "marker")


#: Links of the chain that each lockfile holds.
CHAIN = 10


@query(f"""WITH s AS (SELECT s_suppkey AS k, unnest(['npm', 'old', 'pnpm', 'yarn', 'berry', 'bun', 'cargo']) AS kind FROM supplier)
SELECT CASE kind WHEN 'cargo' THEN 'rust' ELSE 'javascript-typescript' END AS ecosystem, kind || k AS project, 'p0' AS direct, 'p' || i AS member FROM s, range(1, {CHAIN + 1}) r(i)""")
def locked_chains(spark: SparkSession, sf: str) -> DataFrame:
    """What a project reaches in its lockfile, for seven kinds of lockfiles with chains of
    ten: seven projects for each supplier."""
    k, each = F.col("s_suppkey"), range(CHAIN + 1)
    after = lambda i, form: form.format(i + 1) if i < CHAIN else ""
    listed = lambda form: ",".join(form(i) for i in each)
    npm = '{"packages": {"": {"dependencies": {"p0": "^1"}},' + listed(lambda i: f'"node_modules/p{i}": {{"version": "1.0.0"' + after(i, ', "dependencies": {{"p{0}": "^1"}}') + "}") + "}}"
    old = '{"dependencies": {' + listed(lambda i: f'"p{i}": {{"version": "1.0.0"' + after(i, ', "requires": {{"p{0}": "^1"}}') + "}") + "}}"
    pnpm = "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      p0:\n        specifier: ^1\n        version: 1.0.0\nsnapshots:\n" + "".join(f"  p{i}@1.0.0:" + (after(i, "\n    dependencies:\n      p{0}: 1.0.0\n") or " {}\n") for i in each)
    yarn = "".join(f'p{i}@^1:\n  version "1.0.0"\n' + after(i, '  dependencies:\n    p{0} "^1"\n') + "\n" for i in each)
    berry = "__metadata:\n  version: 6\n\n" + "".join(f'"p{i}@npm:^1":\n  version: 1.0.0\n' + after(i, "  dependencies:\n    p{0}: ^1\n") + "\n" for i in each)
    bun = '{"workspaces": {"": {"dependencies": {"p0": "^1"}}}, "packages": {' + listed(lambda i: f'"p{i}": ["p{i}@1.0.0", "", {{' + after(i, '"dependencies": {{"p{0}": "^1"}}') + '}, "x"]') + "}}"
    cargo = "".join(f'[[package]]\nname = "p{i}"\nversion = "1.0.0"\n' + after(i, 'dependencies = ["p{0}"]\n') for i in each)
    rows, made = t(spark, sf, "supplier").select("s_suppkey"), []
    locks = {"npm": ("package-lock.json", npm), "old": ("package-lock.json", old), "pnpm": ("pnpm-lock.yaml", pnpm), "yarn": ("yarn.lock", yarn), "berry": ("yarn.lock", berry), "bun": ("bun.lock", bun), "cargo": ("Cargo.lock", cargo)}
    for kind, (name, text) in locks.items():
        manifest = ("/Cargo.toml", '[package]\nname = "x"\n[dependencies]\np0 = "1"\n') if kind == "cargo" else ("/package.json", '{"dependencies": {"p0": "^1"}}')
        made += [_file(rows, _text(kind, k, "/" + name), F.lit(text)), _file(rows, _text(kind, k, manifest[0]), F.lit(manifest[1]))]
    files = graph.stored(_all(made))
    declared = graph.stored(manifests.declared(files))
    packages = graph.stored(_all([lockfiles.npm_packages(files), lockfiles.npm_tree_packages(files), lockfiles.bun_packages(files)]))
    return analyse.locked_closure(files, declared, packages)

import pytest
from pyspark.sql import functions as F

from factloom.functions import names, paths, text


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_ancestors(spark):
    got = values(spark, paths.ancestors(F.col("x")), ["a/b/c", "a", "."])
    assert got == [["a/b/c", "a/b", "a", "."], ["a", "."], ["."]]
    assert values(spark, paths.ancestors(F.col("x"), strict=True), ["a/b", "."]) == [["a", "."], []]
    assert values(spark, paths.directory(F.col("x")), ["package.json", "a/b.txt", "a/b/c"]) == [".", "a", "a/b"]


def test_file_classes(spark):
    rows = ["src/a.test.ts", "src/test/x.js", "test", "vite.config.ts", "src/.eslintrc.cjs", "tests_data/a.py", "a/conftest.py", "pkg/x_test.py", "src/contest.py"]
    assert values(spark, paths.is_non_shipped(F.col("x")), rows) == [True, True, False, True, True, False, True, True, False]
    assert values(spark, paths.is_safe(F.col("x")), ["a/b", "/a", "a/../b", "C:x", "a\\b", "a..b", "", "a\x00"]) == [True, False, False, False, False, True, False, False]
    got = values(spark, paths.dependency_file(F.col("x")), ["a/package.json", "yarn.lock", "node_modules/x/package.json", "requirements-dev.txt", "requirements/base.txt", "go.sum", "README.md", "dev-requirements.in"])
    assert [None if g is None else tuple(g) for g in got] == [("javascript-typescript", "manifest", None), ("javascript-typescript", "lockfile", "yarn"), None, ("python", "manifest", None), ("python", "manifest", None), ("go", "lockfile", "go-modules"), None, ("python", "manifest", None)]
    assert values(spark, paths.has_excluded_segment(F.col("x")), ["a/dist/b", "distance/b", "x/.git"]) == [True, False, True]
    assert values(spark, paths.is_generated(F.col("x")), ["a.min.js", "a.js", "b.map"]) == [True, False, True]


@pytest.mark.parametrize(("raw", "want"), [("^1.2.3", "registry"), ("workspace:*", "workspace"), ("link:../a", "link"), ("file:x", "file"), ("./x", "file"), ("C:\\x", "file"), ("git+ssh://x", "git"), ("user/repo", "git"), ("user/repo#semver:^1 || 2", "git"), ("user/repo#a b", "registry"), ("npm:x@1", "registry"), ("https://x.example/a.tgz", "registry"), ("https://github.com/a/b.git", "git"), ("git@host.example:a/b.git", "git"), ("latest", "registry"), ("*", "registry")])
def test_specifiers(spark, raw, want):
    assert values(spark, names.specifier_type(F.col("x")), [raw]) == [want]


def test_modules(spark):
    rows = ["react", "@a/b/c", "./x", "..", "/abs", "#sub", "node:fs", "fs/promises", "https://x", "data:text", "@bad", "", "lodash/get"]
    assert values(spark, names.module_kind(F.col("x")), rows) == ["package", "package", "relative", "relative", "relative", "subpath-import", "builtin", "builtin", "url", "url", "invalid", "invalid", "package"]
    assert values(spark, names.module_package(F.col("x")), ["react", "@a/b/c", "lodash/get", "./x"]) == ["react", "@a/b", "lodash", None]


def test_names(spark):
    assert values(spark, names.python_name(F.col("x")), ["A_.b--C", "x"]) == ["a-b-c", "x"]
    assert values(spark, names.types_target(F.col("x")), ["@types/node", "@types/a__b", "node", "@types/a__b__c"]) == ["node", "@a/b", None, "@a/b__c"]
    assert values(spark, names.name_of_key(F.col("x")), ["/@s/a@1.0", "b@npm:^2", "@s/a@^1"]) == ["@s/a", "b", "@s/a"]
    assert values(spark, names.name_in_modules(F.col("x")), ["node_modules/a/node_modules/@s/b", "x"]) == ["@s/b", "x"]
    assert values(spark, names.registry_origin(F.col("x")), ["HTTPS://R.example/a", "https://r.example:80/a", "https://u@r.example/", "ftp://x/"]) == [None, "https://r.example:80", None, None]
    assert values(spark, names.is_public_registry(F.col("x")), ["https://registry.npmjs.org", "https://x", None]) == [True, False, False]
    assert values(spark, names.go_package_name(F.col("x")), ["example.com/go-yaml/v3", "gopkg.in/yaml.v2", "a/b/c-go"]) == ["yaml", "yaml", "c"]


@pytest.mark.parametrize(("version", "wanted", "want"), [("1.2.3", "^1.0.0", "yes"), ("2.0.0", "^1.0.0", "no"), ("0.2.5", "^0.2.1", "yes"), ("0.3.0", "^0.2.1", "no"), ("0.0.3", "^0.0.3", "yes"), ("0.0.4", "^0.0.3", "no"), ("1.2.9", "~1.2.3", "yes"), ("1.3.0", "~1.2.3", "no"), ("1.9.9", "~1", "yes"), ("1.2.3", "1.2.3", "yes"), ("1.2.3", "1.2", "yes"), ("1.2.3", "*", "yes"), ("1.2.3", ">=1.2", "yes"), ("1.2.3", "<1.2.3", "no"), ("1.2.3", "1 || 2", "unknown"), ("1.2.3-beta", "^1.0.0", "unknown"), ("1.2.3", "latest", "unknown")])
def test_ranges(spark, version, wanted, want):
    assert values(spark, text.satisfies(F.col("v"), F.col("r")), [(version, wanted)], "v string, r string") == [want]


def test_versions(spark):
    rows = [("1.2", "1.2.0"), ("1.10", "1.9"), ("v2", "3"), ("x", "1")]
    assert values(spark, text.version_compare(text.version_parts(F.col("a")), text.version_parts(F.col("b"))), rows, "a string, b string") == [0, 1, -1, None]


def test_text(spark):
    assert values(spark, text.byte_size(F.col("x")), [0, 1023, 1024, 1536, 5 << 20, 3 << 30], "x long") == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.0 GiB"]
    assert values(spark, text.clean_statement(F.col("x")), [" a\u202e  b\n", "\u200b ", "x" * 400]) == ["a b", None, "x" * 299 + "…"]
    assert values(spark, text.line_of(F.col("x"), F.lit("z")), ["a\nb\nz z", "z", "a"]) == [3, 1, None]
    assert values(spark, text.grouped(F.col("x")), [1234567], "x long") == ["1,234,567"]
    a, b = values(spark, text.set_hash(F.col("x")), [(["b", "a", "b"],), (["a", "b"],)], "x array<string>")
    assert a == b and len(a) == 64


def test_values_are_worked_out_once(spark):
    """The expressions name each value once: their size does not multiply with their parts."""
    from factloom.functions import markers, text

    rows = spark.createDataFrame([("1.2.3", ">=1.2"), ("1.2.99999999999", "<2"), ("0.3.1", "^0.3")], "v string, r string")
    size = lambda c: len(rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString())
    fits, floor = text.satisfies(F.col("v"), F.col("r")), markers.floor(F.col("r"))
    assert [r[0] for r in rows.select(fits).collect()] == ["yes", "yes", "yes"]
    assert str(rows.select(fits.alias("x"))._jdf.queryExecution().optimizedPlan().toString()).count("regexp_extract(v") == 1
    assert size(floor) < 12_000

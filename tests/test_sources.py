import pytest
from pyspark.sql import functions as F

from factloom.operators import changes, graph, health, report
from factloom.sources import configs, diffs, files, lockfiles, manifests, references

FILES = "path string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, FILES)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_package_json(spark):
    text = '{\n  "name": "app",\n  "dependencies": {\n    "a": "^1.0.0",\n    "b": "github:x/y",\n    "c": 3\n  },\n  "devDependencies": {\n    "a": "2"\n  },\n  "optionalDependencies": {\n    "b": "1"\n  }\n}'
    rows = table(spark, [("web/package.json", text), ("bad/package.json", "{"), ("package.json", "[]"), ("dup/package.json", '{"a":1,"a":2}')])
    got = tuples(manifests.package_json(rows), "project", "name", "constraint", "kind", "declared_line", "specifier_type")
    assert got == [("web", "a", "2", "dev", 9, "registry"), ("web", "a", "^1.0.0", "runtime", 4, "registry"), ("web", "b", "1", "optional", 12, "registry"), ("web", "c", "3", "runtime", 6, "registry")]
    found = tuples(manifests.problems(rows), "path", "statement")
    assert [p for p, _ in found] == ["bad/package.json", "dup/package.json", "web/package.json"]


def test_requirements(spark):
    text = "# top\nRequests[socks]==2.0 ; python_version > '3' # why\n-r base.txt\nflask \\\n  >= 1.0\n\nmine @ git+https://x.example/y\n--index-url https://x\nnot a name!!\nlast~=1\n"
    rows = table(spark, [("svc/requirements-dev.txt", text), ("svc/base.txt", "x"), ("requirements.txt", "-c ../out.txt\n-r sub/./more.txt\nzope.interface\n")])
    got = tuples(manifests.requirements(rows), "project", "name", "constraint", "kind", "declared_line", "specifier_type")
    assert got == [(".", "zope-interface", "", "runtime", 3, "registry"), ("svc", "flask", ">= 1.0", "dev", 4, "registry"), ("svc", "last", "~=1", "dev", 10, "registry"), ("svc", "mine", "@ git+https://x.example/y", "dev", 7, "git"), ("svc", "requests", "==2.0", "dev", 2, "registry")]
    assert tuples(manifests.includes(rows), "path", "included") == [("requirements.txt", "sub/more.txt"), ("svc/requirements-dev.txt", "svc/base.txt")]


def test_go_mod(spark):
    text = 'module example.com/x\n\ngo 1.22\n\nrequire (\n\texample.com/a v1.0.0\n\texample.com/b v2.0.0 // indirect\n\t"example.com/c" v1.1.0\n)\n\nrequire example.com/d v0.1.0\n\nreplace example.com/a v1.0.0 => ../a\nreplace (\n\texample.com/c => example.com/fork v1.2.0\n)\n'
    got = tuples(manifests.go_mod(table(spark, [("go.mod", text)])), "name", "constraint", "declared_line", "specifier_type")
    assert got == [("example.com/a", "v1.0.0", 6, "file"), ("example.com/c", "v1.1.0", 8, "registry"), ("example.com/d", "v0.1.0", 11, "registry")]


def test_toml(spark):
    project = '[project]\ndependencies = ["Flask>=1; extra == \'x\'", "y @ file:../y"]\n[project.optional-dependencies]\nt = ["pytest"]\n[build-system]\nrequires = ["hatchling"]\n[tool.poetry.dependencies]\npython = "^3"\nz = {git = "u"}\n'
    cargo = '[dependencies]\nserde = "1"\nalias = {package = "real", version = "2", optional = true}\n[target."cfg(unix)".dev-dependencies]\nnix = {path = "../nix"}\n'
    rows = table(spark, [("pyproject.toml", project), ("r/Cargo.toml", cargo), ("bad/Pipfile", "[[")])
    got = tuples(manifests.toml(rows), "ecosystem", "name", "constraint", "kind", "specifier_type")
    assert ("python", "flask", ">=1", "runtime", "registry") in got and ("python", "y", "@ file:../y", "runtime", "file") in got
    assert ("python", "pytest", "", "optional", "registry") in got and ("python", "hatchling", "", "build", "registry") in got and ("python", "z", None, "runtime", "git") in got
    assert ("rust", "real", "2", "optional", "registry") in got and ("rust", "nix", None, "dev", "file") in got
    assert [g[3] for g in got if g[1] is None] == ["problem"] and len(got) == 9


def test_npm_lockfile_nearest_copy(spark):
    text = """{"lockfileVersion": 3, "packages": {"": {"name": "app", "dependencies": {"lite": "1", "gone": "1"}},
      "node_modules/lite": {"version": "1.0.0", "dependencies": {"debug": "2", "mime": "1"}, "resolved": "https://registry.npmjs.org/lite/-/lite-1.0.0.tgz"},
      "node_modules/lite/node_modules/debug": {"version": "2.0.0", "dependencies": {"ms": "1"}},
      "node_modules/debug": {"version": "3.0.0", "dev": true}, "node_modules/mime": {"version": "1.0.0"}, "node_modules/ms": {"version": "1.0.0"}}}"""
    packages = lockfiles.npm_packages(table(spark, [("package-lock.json", text)]))
    assert tuples(packages.where("key != ''"), "name", "version", "dev")[:2] == [("debug", "2.0.0", False), ("debug", "3.0.0", True)]
    edges = lockfiles.npm_edges(packages)
    lite = "node_modules/lite"
    assert tuples(edges, "src", "name", "dst") == [("", "gone", None), ("", "lite", lite), (lite, "debug", lite + "/node_modules/debug"), (lite, "mime", "node_modules/mime"), (lite + "/node_modules/debug", "ms", "node_modules/ms")]
    reach = graph.closure(edges.where("src != ''"))
    assert sorted(r.dst for r in reach.where(f"src = '{lite}'").collect()) == ["node_modules/lite/node_modules/debug", "node_modules/mime", "node_modules/ms"]


def test_yarn_classic(spark):
    text = '# yarn lockfile v1\n\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.2.0"\n  resolved "https://x"\n  dependencies:\n    b "^2.0.0"\n    "@s/c" "1"\n\nb@^2.0.0:\n  version "2.1.0"\n'
    packages = lockfiles.yarn_classic(table(spark, [("yarn.lock", text)]))
    assert tuples(packages, "name", "version", "patterns", "requires") == [("@s/a", "1.2.0", ["@s/a@^1.0.0", "@s/a@^1.1.0"], ["b@^2.0.0", "@s/c@1"]), ("b", "2.1.0", ["b@^2.0.0"], [])]
    edges = lockfiles.yarn_edges(packages).collect()
    assert sorted((r.pattern, r.dst is not None) for r in edges) == [("@s/c@1", False), ("b@^2.0.0", True)]


def test_toml_lockfiles(spark):
    cargo = '[[package]]\nname = "a"\nversion = "1.0.0"\ndependencies = ["b 1.0.0", "c"]\n[[package]]\nname = "b"\nversion = "1.0.0"\n[[package]]\nname = "b"\nversion = "2.0.0"\n'
    packages = lockfiles.toml_packages(table(spark, [("Cargo.lock", cargo), ("x/uv.lock", "[[")]))
    assert tuples(lockfiles.name_edges(packages), "src", "dst", "forked") == [("a", "b", True), ("a", None, False)]


def test_nearest_lockfile(spark):
    rows = table(spark, [("yarn.lock", ""), ("package-lock.json", ""), ("apps/web/pnpm-lock.yaml", "")])
    projects = spark.createDataFrame([("apps/web",), ("apps",), (".",), ("apps/web/x",)], "project string")
    got = dict(tuples(lockfiles.nearest_lockfile(projects, rows, ["package-lock.json", "yarn.lock"]), "project", "lockfile"))
    assert got == {"apps/web": "apps/web/pnpm-lock.yaml", "apps/web/x": "apps/web/pnpm-lock.yaml", "apps": "package-lock.json", ".": "package-lock.json"}


DIFF = """diff --git a/src/a.js b/src/a.js
index 1..2 100644
--- a/src/a.js
+++ b/src/a.js
@@ -1,4 +1,4 @@ fn
 one
-two
+TWO
+two and a half
 three
-four
\\ No newline at end of file
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/x.bin b/x.bin
Binary files a/x.bin and b/x.bin differ
"""


def test_unified_diff_and_its_base(spark):
    lines = diffs.diff_lines(spark.createDataFrame([(1, DIFF)], "id int, text string"))
    assert tuples(diffs.added(lines), "path", "line", "text") == [("src/a.js", 2, "TWO"), ("src/a.js", 3, "two and a half")]
    assert tuples(diffs.removed(lines), "path", "line", "text") == [("gone.txt", 1, "bye"), ("src/a.js", 2, "two"), ("src/a.js", 4, "four")]
    head = table(spark, [("src/a.js", "one\nTWO\ntwo and a half\nthree")])
    base = diffs.base_text(head, lines.where("path = 'src/a.js'"))
    assert tuples(base, "line", "text") == [(1, "one"), (2, "two"), (3, "three"), (4, "four")]


def test_javascript(spark):
    text = """import a, { b } from 'pkg-a';
import type { T } from "@s/types";
import 'side';
export * from './local';
// import x from 'commented';
const d = require("dyn/sub"); const e = await import('lazy');
jest.mock('mocked'); require(name); import(`t${x}`);
"""
    got = tuples(references.javascript(table(spark, [("src/a.ts", text), ("dist/b.js", "require('no')"), ("c.txt", "require('no')")])), "specifier", "form", "type_only", "package")
    assert got == [("./local", "static", False, None), ("@s/types", "static", True, "@s/types"), ("dyn/sub", "require", False, "dyn"), ("lazy", "dynamic", False, "lazy"), ("mocked", "require", False, "mocked"), ("pkg-a", "static", False, "pkg-a"), ("side", "static", False, "side")]
    assert tuples(references.javascript_gaps(table(spark, [("a.js", text), ("b.js", "require('x')")])), "path", "n") == [("a.js", 2)]


def test_python(spark):
    text = 'import os, numpy as np\nfrom google.cloud import storage\nfrom . import mine\n"""\nimport nothing\n"""\n# import no\nif x:\n    import yaml\nm = importlib.import_module("lazy.mod")\n'
    imports = references.python(table(spark, [("a.py", text)]))
    assert tuples(imports, "module", "form", "conditional") == [("google.cloud", "static", False), ("lazy.mod", "dynamic", False), ("numpy", "static", False), ("os", "static", False), ("yaml", "static", True)]
    known = spark.createDataFrame([("yaml", "PyYAML"), ("google", "google"), ("google.cloud", "google-cloud-core")], "module string, distribution string")
    own = spark.createDataFrame([("lazy",)], "module string")
    got = dict(tuples(references.python_distributions(imports, known, own), "module", "distribution"))
    assert got == {"google.cloud": "google-cloud-core", "numpy": "numpy", "os": "os", "yaml": "pyyaml"}


def test_go_and_rust(spark):
    go = 'package x\nimport (\n\t"fmt"\n\tm "example.com/m/v2" // why\n\t// "example.com/no"\n)\nimport "one"\n'
    assert tuples(references.go(table(spark, [("x.go", go), ("vendor/y.go", go)])), "path", "module") == [("x.go", "example.com/m/v2"), ("x.go", "fmt"), ("x.go", "one")]
    rust = 'use serde::Deserialize;\npub use crate::a;\nextern crate libc;\nlet x = tokio::spawn("rand::no"); std::mem::drop(1);\n'
    assert tuples(references.rust(table(spark, [("a.rs", rust)])), "crate") == [("libc",), ("serde",), ("tokio",)]


def test_scripts_and_workflows(spark):
    rows = table(spark, [("package.json", '{"scripts": {"b": "NODE_ENV=x cross-env A=1 vite build && npx tsc -p . | tee x", "t": "jest"}}'), (".github/workflows/ci.yml", "jobs:\n  a:\n    steps:\n      - run: npm test\n      - run: |\n          eslint .\n          prettier -c .\n      - uses: x\n")])
    scripts = references.package_scripts(rows)
    assert tuples(references.commands(scripts), "name", "command") == [("b", "tee"), ("b", "tsc"), ("b", "vite"), ("t", "jest")]
    assert [s.strip().split("\n")[0].strip() for (s,) in tuples(references.workflow_steps(rows), "script")] == ["eslint .", "npm test"]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "README").write_text("hello")
    assert tuples(files.tree(spark, f"file://{tmp_path}"), "path", "size") == [("README", 5), ("src/a.py", 5)]
    entries = [("a.js", 5, "file"), ("b.js", 9, "file"), ("b/c.js", 1, "file"), ("l", 1, "symlink"), ("s", 1, "socket"), ("node_modules/x.js", 1, "file"), ("x.min.js", 1, "file"), ("big.js", 99, "file"), ("yarn.lock", 99, "file"), ("../x", 1, "file"), ("d/e/f/g.js", 1, "file")]
    df = spark.createDataFrame(entries, "path string, size long, kind string")
    limits = files.Limits(file_bytes=50, depth=3, total_bytes=120)
    kept, skipped = files.scanned(df, limits)
    assert [p for (p,) in tuples(kept, "path")] == ["a.js", "b.js", "b/c.js", "yarn.lock"]
    assert dict(tuples(skipped, "path", "reason")) == {"l": "symlink", "s": "special-file", "node_modules/x.js": "excluded-directory", "x.min.js": "generated-file", "big.js": "file-too-large", "../x": "unsafe-name", "d/e/f/g.js": "too-deep"}
    kept, skipped = files.scanned(df, files.Limits(file_bytes=50, total_bytes=14))
    assert [p for (p,) in tuples(kept, "path")] == ["a.js", "b.js"]
    kept, _ = files.scanned(df, files.Limits(file_bytes=50, files=1))
    assert [p for (p,) in tuples(kept, "path")] == ["a.js"]
    with pytest.raises(ValueError):
        files.Limits(files=-1)


def test_scope(spark):
    rows = table(spark, [("fx/a/package.json", ""), ("fx/b.js", ""), ("fxx/c.js", ""), ("d.js", "")])
    roots = spark.createDataFrame([("fx",), ("none",)], "root string")
    assert tuples(files.scope_counts(rows, roots)) == [("fx", True, 2, 1), ("none", False, 0, 0)]
    assert tuples(files.outside(rows, roots), "path") == [("d.js",), ("fxx/c.js",)]


def test_changes_and_coverage(spark):
    row = "ecosystem string, project string, name string, kind string, constraint string"
    base = spark.createDataFrame([("js", ".", "a", "dev", "1"), ("js", ".", "b", "runtime", "1"), ("js", ".", "c", "runtime", "1")], row)
    head = spark.createDataFrame([("js", ".", "a", "runtime", "2"), ("js", ".", "b", "runtime", "2"), ("go", "x", "d", "runtime", "1")], row)
    found = changes.dependency_changes(base, head)
    assert tuples(found, "name", "change", "kind_before", "kind_after", "before", "after") == [("a", "changed", "dev", "runtime", "1", "2"), ("b", "changed", "runtime", "runtime", "1", "2"), ("c", "removed", "runtime", None, "1", None), ("d", "added", None, "runtime", None, "1")]
    listed = spark.createDataFrame([("js", ".", "b")], "ecosystem string, project string, name string")
    seen = spark.createDataFrame([("js",)], "ecosystem string")
    assert tuples(changes.coverage(found, listed, seen), "name", "reason") == [("a", "not listed"), ("d", "ecosystem not analysed")]
    changed = table(spark, [("package.json", ""), ("apps/x/package.json", ""), ("apps/yarn.lock", ""), ("py/pyproject.toml", ""), ("py/yarn.lock", "")])
    assert tuples(changes.uncovered_manifests(changed), "path") == [("package.json",), ("py/pyproject.toml",)]
    assert changes.is_source_only(table(spark, [("a.ts", ""), ("README", "")]), True)
    assert not changes.is_source_only(table(spark, [("a.ts", ""), ("go.mod", "")]), True)
    assert not changes.is_source_only(table(spark, [("a.ts", "")]), False)


def test_verified_lines(spark):
    rows = table(spark, [("requirements.txt", "Zope.Interface>=1\nother"), ("package.json", '{"a-b": 1,\n"a": 2}')])
    declared = spark.createDataFrame([("python", "zope-interface", "requirements.txt", 1), ("python", "other", "requirements.txt", 1), ("js", "a", "package.json", 1), ("js", "a", "package.json", 2), ("js", "x", "gone", 1)], "ecosystem string, name string, declared_in string, declared_line int")
    assert tuples(changes.verified_lines(declared, manifests.lines(rows)), "name", "declared_line") == [("a", 2), ("a", None), ("other", None), ("x", None), ("zope-interface", 1)]


def test_health(spark):
    key = "ecosystem string, project string, name string"
    direct = spark.createDataFrame([("js", ".", "a"), ("js", ".", "b"), ("js", ".", "c")], key)
    nodes = spark.createDataFrame([("js", ".", "a", "1", "o"), ("js", ".", "b", "1", "o"), ("js", ".", "b", "2", "o"), ("js", ".", "c", "1", "o")], key + ", version string, origin string")
    registry = spark.createDataFrame([("js", "a", "1", True, None, "2024-02-30"), ("js", "c", "1", True, True, "2024-13-01"), ("js", "c", "1", True, True, "x")], "ecosystem string, name string, version string, deprecated boolean, archived boolean, published string")
    locked = health.locked_version(direct, nodes)
    assert tuples(locked, "name") == [("a",), ("c",)]
    assert tuples(health.facts(locked, registry), "name", "signal") == [("a", "locked-version-published"), ("a", "registry-deprecated")]


def test_reports(spark, tmp_path):
    rows = [("unused", "unused", "medium", "high", "b", "p.json", 3, "verdict"), ("info", "x", "info", "high", "a", "p.json", 4, "note"), ("unused", "unused", "low", "high", "c", None, None, "verdict")]
    found = spark.createDataFrame(rows, "kind string, rule string, severity string, confidence string, dependency string, file string, line int, finding_group string")
    assert [r.dependency for r in report.ordered(found).collect()] == ["b", "c", "a"]
    added = spark.createDataFrame([("p.json", 3)], "path string, line int")
    assert tuples(report.annotated(found, added), "dependency") == [("b",)]
    assert tuples(report.outcome(found, "medium")) == [("neutral", 2, 1, "medium")]
    assert tuples(report.outcome(found.where("dependency = 'a'"), "medium")) == [("success", 0, 0, None)]
    report.written(found, f"file://{tmp_path}/r")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/r").collect()]
    assert len(lines) == 3 and lines[0].startswith('{"confidence":"high","dependency":"b"')


def test_yarn_berry(spark):
    text = '# note\n\n__metadata:\n  version: 8\n  cacheKey: 10\n\n"@s/a@npm:^1.0.0, @s/a@npm:^1.1.0":\n  version: 1.2.0\n  resolution: "@s/a@npm:1.2.0"\n  dependencies:\n    b: ^2.0.0\n    "@s/c": "npm:1"\n  peerDependencies:\n    react: "*"\n  languageName: node\n\n"b@npm:^2.0.0":\n  version: 2.1.0\n\n? "long@npm:^3"\n:\n  version: "3.0.0"\n\n"root@workspace:.":\n  version: 0.0.0-use.local\n  dependencies:\n    "@s/a": ^1.1.0\n    web: "workspace:^"\n'
    packages = lockfiles.yarn_berry(table(spark, [("yarn.lock", text), ("x/yarn.lock", "a@1:\n  version \"1\"\n")]))
    assert tuples(packages, "name", "version", "patterns", "requires") == [
        ("@s/a", "1.2.0", ["@s/a@npm:^1.0.0", "@s/a@npm:^1.1.0"], ["b@npm:^2.0.0", "@s/c@npm:1"]), ("b", "2.1.0", ["b@npm:^2.0.0"], []),
        ("long", "3.0.0", ["long@npm:^3"], []), ("root", "0.0.0-use.local", ["root@workspace:."], ["@s/a@npm:^1.1.0", "web@workspace:^"]),
    ]
    edges = lockfiles.yarn_edges(packages).collect()
    assert sorted((r.pattern, r.dst is not None) for r in edges) == [("@s/a@npm:^1.1.0", True), ("@s/c@npm:1", False), ("b@npm:^2.0.0", True), ("web@workspace:^", False)]


def test_bun(spark):
    text = """{ // text form
      "lockfileVersion": 1,
      "workspaces": {"": {"name": "app", "dependencies": {"a": "1"}, "devDependencies": {"@s/b": "1"},}, "packages/x": {"name": "x", "dependencies": {"a": "2", "@s/b": "1"}},},
      "packages": {
        "a": ["a@1.0.0", "", {"dependencies": {"c": "1"}}, "sha512-x"], "a/c": ["c@1.0.0", "", {}, "sha512-x"], "c": ["c@2.0.0", "", {}, "sha512-x"],
        "@s/b": ["@s/b@git+https://x.example/b#1", {"dependencies": {"c": "2"}}, "1"], "x": ["x@workspace:packages/x"], "x/a": ["a@2.0.0", "https://npm.example/a.tgz", {"optionalDependencies": {"c": "1"}}, "sha512-x"],
      },
    }"""
    packages = lockfiles.bun_packages(table(spark, [("bun.lock", text), ("bad/bun.lock", "{")]))
    a, c, b, xa = "node_modules/a", "node_modules/c", "node_modules/@s/b", "packages/x/node_modules/a"
    assert ("node_modules/a/node_modules/c", "c", "1.0.0", None) in tuples(packages, "key", "name", "version", "origin") and (xa, "a", "2.0.0", "https://npm.example") in tuples(packages, "key", "name", "version", "origin")
    assert tuples(lockfiles.npm_edges(packages), "src", "name", "dst") == [("", "@s/b", b), ("", "a", a), (b, "c", c), (a, "c", a + "/node_modules/c"), ("packages/x", "@s/b", b), ("packages/x", "a", xa), (xa, "c", c)]


def test_nested_npm_lockfile(spark):
    text = '{"lockfileVersion": 1, "requires": true, "dependencies": {"a": {"version": "1.0.0", "requires": {"b": "2", "gone": "1"}, "dependencies": {"b": {"version": "2.0.0", "requires": {"c": "1"}}}}, "b": {"version": "1.0.0", "dev": true}, "c": {"version": "1.0.0"}}}'
    rows = [("p/package-lock.json", text), ("p/package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "1"}}'), ("q/package-lock.json", '{"packages": {"": {}}, "dependencies": {"z": {}}}'), ("bad/package-lock.json", "{")]
    packages = lockfiles.npm_tree_packages(table(spark, rows))
    a = "node_modules/a"
    assert tuples(packages.where("key != ''"), "key", "version", "dev") == [(a, "1.0.0", False), (a + "/node_modules/b", "2.0.0", False), ("node_modules/b", "1.0.0", True), ("node_modules/c", "1.0.0", False)]
    assert tuples(lockfiles.npm_edges(packages), "src", "name", "dst") == [("", "a", a), ("", "b", "node_modules/b"), (a, "b", a + "/node_modules/b"), (a, "gone", None), (a + "/node_modules/b", "c", "node_modules/c")]
    assert lockfiles.npm_tree_packages(table(spark, [])).count() == 0


def test_nested_npm_lockfiles_are_read_once(spark, monkeypatch):
    written = []
    kept = lockfiles.stored
    monkeypatch.setattr(lockfiles, "stored", lambda df: written.append(df) or kept(df))
    deep = '{"dependencies": {"a": {"dependencies": {"b": {"dependencies": {"c": {"version": 1.50, "dev": "true", "requires": {"a": 1}}}}}}}}'
    rows = [("p/package-lock.json", deep), ("p/package.json", None), ("q/package-lock.json", '{"dependencies": {"a": {}, "a": {}}}'), ("r/package-lock.json", '{"dependencies": {"\\ud800": {"version": "x"}}} more'), ("s/package-lock.json", '{"dependencies": {"a": "1", "b": null}}')]
    packages = lockfiles.npm_tree_packages(table(spark, rows))
    assert len(written) == 1
    a, b = "node_modules/a", "node_modules/a/node_modules/b"
    assert tuples(packages, "lockfile", "key", "version", "dev", "requires") == [
        ("p/package-lock.json", "", None, False, []), ("p/package-lock.json", a, None, False, []), ("p/package-lock.json", b, None, False, []), ("p/package-lock.json", b + "/node_modules/c", "1.5", True, ["a"]),
        ("r/package-lock.json", "node_modules/?", "x", False, []), ("s/package-lock.json", a, None, False, []), ("s/package-lock.json", "node_modules/b", None, False, []),
    ]
    assert tuples(lockfiles.npm_edges(packages), "src", "name", "dst") == [(b + "/node_modules/c", "a", a)]


def test_workspace_sees_the_root(spark):
    text = '{"packages": {"": {}, "packages/x": {"name": "x", "dependencies": {"a": "1", "b": "1"}}, "packages/x/node_modules/b": {"version": "2"}, "node_modules/a": {"version": "1"}, "node_modules/b": {"version": "1"}}}'
    packages = lockfiles.npm_packages(table(spark, [("package-lock.json", text)]))
    assert tuples(lockfiles.npm_edges(packages), "src", "name", "dst") == [("packages/x", "a", "node_modules/a"), ("packages/x", "b", "packages/x/node_modules/b")]


def test_scoped_registries(spark):
    text = "registry=https://registry.npmjs.org\n@a:registry=https://OLD.example\n@a:registry = \"https://NPM.example/x/\"\n# @b:registry=https://no.example\n//npm.example/:_authToken=t\n@c:registry=https://u:p@x.example\n"
    got = tuples(lockfiles.scoped_registries(table(spark, [(".npmrc", text), ("w/.npmrc", ""), ("npmrc", text)])))
    assert got == [(".", "@a", "https://npm.example"), (".", "@c", None)]


def test_pnpm_documents_and_versions(spark):
    body = "lockfileVersion: '{v}'\nimporters:\n  .:\n    dependencies:\n      a:\n        specifier: 1\n        version: {n}.0.0\nsnapshots:\n  a@{n}.0.0: {{}}\n"
    files = [
        ("one/pnpm-lock.yaml", body.format(v="9.0", n=1)), ("two/pnpm-lock.yaml", "---\n" + body.format(v="9.0", n=2) + "---\n" + body.format(v="9.0", n=3)), ("three/pnpm-lock.yaml", "---\n".join([body.format(v="9.0", n=1)] * 3)),
        ("old/pnpm-lock.yaml", body.format(v="5.4", n=1)), ("none/pnpm-lock.yaml", "x: 1\n"), ("empty/pnpm-lock.yaml", ""), ("null/pnpm-lock.yaml", None),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    assert {(r.lockfile, r.dst) for r in lockfiles.pnpm(df).collect()} == {("one/pnpm-lock.yaml", "a@1.0.0"), ("two/pnpm-lock.yaml", "a@3.0.0")}
    assert {r.lockfile.split("/")[0]: r.reason for r in lockfiles.pnpm_problems(df).collect()} == {
        "three": "expected one or two documents, found 3", "old": "lockfile version 5 is not read", "none": "lockfile version none is not read", "empty": "expected one or two documents, found 0", "null": "no text",
    }


def test_jest_projects_and_other_tools(spark):
    jest = '{"preset": "p1", "reporters": ["default", "r1"], "testSequencer": "s1", "projects": [{"preset": "p2", "reporters": ["r2"], "watchPlugins": ["w2"], "testSequencer": "s2", "testResultsProcessor": "t2", "runner": "eslint"}]}'
    files = [("jest.config.json", jest), (".prettierrc", '{"plugins": ["prettier-plugin-x"], "overrides": [{"options": {"plugins": ["deep"]}}]}'), ("package.json", '{"prettier": "@acme/shared", "postcss": {"parser": "sugarss", "plugins": {"nano": {}}}}')]
    got = {(r.setting, r.name): r.packages for r in configs.references(spark.createDataFrame(files, "path string, text string")).collect()}
    assert set(got) == {
        ("jest preset", "p1"), ("jest reporters", "r1"), ("jest testSequencer", "s1"), ("jest preset", "p2"), ("jest runner", "eslint"), ("prettier plugins", "prettier-plugin-x"), ("prettier plugins", "deep"), ("prettier shared config", "@acme/shared"), ("postcss parser", "sugarss"), ("postcss plugins", "nano"),
    }
    assert got["jest runner", "eslint"] == ["eslint", "jest-runner-eslint"]


@pytest.mark.parametrize(("name", "prefix", "want"), [
    ("x", "eslint-config", ["x", "eslint-config-x"]), ("eslint-config-x", "eslint-config", ["eslint-config-x"]), ("@s", "eslint-config", ["@s/eslint-config"]), ("@s/x", "eslint-config", ["@s/x", "@s/eslint-config-x"]), ("@s/eslint-config", "eslint-config", ["@s/eslint-config"]),
    ("x/deep/file", "eslint-config", ["x", "eslint-config-x"]), ("./x", "eslint-config", []), ("/x", "", []), ("<rootDir>/x", "", []), ("a:b", "x", []), ("module:x", "babel-plugin", ["x", "babel-plugin-x"]), ("@babel/x", "babel-plugin", ["@babel/x", "@babel/babel-plugin-x", "@babel/plugin-x"]),
    ("@babel/plugin-x", "babel-plugin", ["@babel/plugin-x", "@babel/babel-plugin-plugin-x"]), ("x", "@types", ["x", "@types/x"]), ("@s/x", "@types", ["@s/x", "@types/s__x"]), ("x", "", ["x"]), (" x ", "", ["x"]), ("", "", []),
])
def test_names_that_tools_complete(spark, name, prefix, want):
    row = spark.createDataFrame([(name, prefix)], "n string, p string").select(configs.candidates(F.col("n"), F.col("p")).alias("c")).first()
    assert sorted(row.c) == sorted(want)


def test_package_json_lines_of_a_long_file(spark):
    from factloom.sources import manifests

    many = ",\n".join(f'    "p{i}": "^1"' for i in range(400))
    text = '{\n  "name": "p7",\n  "devDependencies": {"p1": "2", "q": "p3"},\n  "dependencies": {\n' + many + "\n  }\n}"
    found = manifests.package_json(spark.createDataFrame([("a/package.json", text)], "path string, text string"))
    lines = {(r["kind"], r["name"]): r["declared_line"] for r in found.collect()}
    assert lines == {("dev", "p1"): 3, ("dev", "q"): 3, **{("runtime", f"p{i}"): 5 + i for i in range(400)}}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "instr(substring" not in plan, "each dependency searches the whole text"


def shuffles(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_files_and_edges_are_dealt_once(spark):
    """A text's rows are not sorted, joined and dealt anew for each step of its reading."""
    one = spark.createDataFrame([("a", "--- a/x\n+++ b/x\n@@ -1 +5 @@\n-old\n+new\n same\n@@ -9 +9 @@\n+more")], "id string, text string")
    lines = diffs.diff_lines(one)
    assert tuples(lines, "path", "hunk", "type", "old_line", "new_line", "text") == sorted([("x", 1, "del", 1, None, "old"), ("x", 1, "add", None, 5, "new"), ("x", 1, "context", 2, 6, "same"), ("x", 2, "add", None, 9, "more")], key=repr)
    assert shuffles(lines) == 0
    texts = table(spark, [("a.ts", "import type { T } from 't';\nimport t from 't';\nrequire('r')")])
    found = references.javascript(texts)
    assert tuples(found, "specifier", "form", "type_only") == [("r", "require", False), ("t", "static", False)]
    assert shuffles(found) == 1
    lock = '{"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"dependencies": {"b": "1", "c": "1"}}, "node_modules/b": {}, "node_modules/a/node_modules/b": {}}}'
    edges = lockfiles.npm_edges(lockfiles.npm_packages(table(spark, [("package-lock.json", lock)])))
    assert tuples(edges, "src", "dst", "name") == [("", "node_modules/a", "a"), ("node_modules/a", "node_modules/a/node_modules/b", "b"), ("node_modules/a", None, "c")]
    assert shuffles(edges) == 1
    bun = '{"workspaces": {"": {"dependencies": {"a": "1"}}, "w": {"name": "w"}}, "packages": {"a": ["a@1", "", {}], "w/a": ["a@2", "", {}]}}'
    packages = lockfiles.bun_packages(table(spark, [("bun.lock", bun)]))
    assert tuples(packages, "key", "name", "version") == sorted([("", None, None), ("w", "w", None), ("node_modules/a", "a", "1"), ("w/node_modules/a", "a", "2")], key=repr)
    assert shuffles(packages) == 0

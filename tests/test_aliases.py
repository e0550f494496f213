import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.plans.analyse import analysed
from factloom.sources import aliases, references


def internal(spark, files, source="import x from '{}';", specifiers=(), at="src/main.ts"):
    text = "\n".join(source.format(s) for s in specifiers)
    df = spark.createDataFrame([*files.items(), (at, text)], "path string, text string")
    return {(r.path, r.specifier): r.file for r in aliases.internal(references.javascript(df), df).collect()}


def config(**options):
    extends = {"extends": options.pop("extends")} if "extends" in options else {}
    return json.dumps({**extends, "compilerOptions": options})


def test_paths_are_resolved(spark):
    rows = [("a/b", "./c"), ("a/b", "../c/./d"), ("a", "../../x"), (".", "x/y/.."), (".", "."), ("a", "/x"), ("a", ".."), (".", ".."), ("a", None)]
    df = spark.createDataFrame(rows, "f string, r string").select(paths.resolved(F.col("f"), F.col("r")).alias("x"))
    assert [r.x for r in df.collect()] == ["a/b/c", "a/c/d", None, "x", ".", "x", ".", None, None]


def test_exact_keys_longest_beginnings_and_finality(spark):
    files = {
        "tsconfig.json": config(baseUrl=".", paths={"*": ["all/*"], "@app/*": ["gone/*"], "@app/db": ["src/db"], "@app/ui/*": ["missing/*", "src/ui/*"], "lib-*-x": ["src/lib/*"], "lib-a-x": ["nothing"]}),
        "src/db.ts": "", "src/ui/button/index.tsx": "", "all/util.js": "", "util2.ts": "", "src/lib/b.d.ts": "", "src/lib/a.ts": "", "src/ui/x.ts": "", "all/@app/z.ts": "",
    }
    got = internal(spark, files, specifiers=["@app/db", "@app/ui/button", "@app/x", "util", "util2", "lib-b-x", "lib-a-x", "react", "@app/z", "./db", "node:fs"])
    assert got == {("src/main.ts", "@app/db"): "src/db.ts", ("src/main.ts", "@app/ui/button"): "src/ui/button/index.tsx", ("src/main.ts", "util"): "all/util.js", ("src/main.ts", "lib-b-x"): "src/lib/b.d.ts"}


def test_base_url_endings_and_folders(spark):
    files = {
        "tsconfig.json": config(baseUrl="src"), "src/a.mts": "", "src/b/index.ts": "", "src/c/package.json": '{"typings": "", "types": "lib/t", "main": "m.js"}', "src/c/lib/t.d.ts": "", "src/c/index.ts": "",
        "src/d/package.json": '{"main": "gone.js"}', "src/d/index.ts": "", "src/e.ts": "", "src/f.mts": "", "src/g/package.json": "{not json", "src/g/index.js": "", "src/node_modules/h.ts": "",
    }
    got = internal(spark, files, specifiers=["a", "b", "c", "d", "e.js", "f.mjs", "f.js", "g", "node_modules/h"])
    assert {s: f for (_, s), f in got.items()} == {"a": "src/a.mts", "b": "src/b/index.ts", "c": "src/c/lib/t.d.ts", "e.js": "src/e.ts", "f.mjs": "src/f.mts", "g": "src/g/index.js"}


def test_the_nearest_configuration_and_workspace_bases(spark):
    files = {
        "tsconfig.json": config(paths={"x": ["./root.ts"]}), "root.ts": "", "app/jsconfig.json": config(paths={"x": ["./no.ts"]}), "app/tsconfig.json": config(extends="@repo/config/base.json"), "app/own.ts": "",
        "config/package.json": '{"name": "@repo/config", "tsconfig": "main.json"}', "config/base.json": config(extends="@repo/config", paths={"x": ["../app/own"]}), "config/main.json": config(baseUrl="../deep"), "deep/y.ts": "",
        "twice/a/package.json": '{"name": "two"}', "twice/b/package.json": '{"name": "two"}', "bad/tsconfig.json": config(extends=["two", "./gone", "@tsconfig/node20"]),
    }
    got = internal(spark, files, specifiers=["x", "y"], at="app/src/m.ts")
    # The base of the base sets baseUrl, from which paths count then.
    assert got == {("app/src/m.ts", "x"): "app/own.ts", ("app/src/m.ts", "y"): "deep/y.ts"}
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    assert {(r.path, r.spec) for r in aliases.broken(df).collect()} == {("bad/tsconfig.json", "two"), ("bad/tsconfig.json", "./gone")}


def merged(graph, name, seen=()):
    """base and paths of a configuration by recursion."""
    own = dict(graph[name][1])
    for base in reversed(graph[name][0]):
        if base in graph and base not in (*seen, name):
            for k, v in merged(graph, base, (*seen, name)).items():
                own.setdefault(k, v)
    return own


@pytest.mark.parametrize("seed", range(2))
def test_inheritance_on_random_graphs(spark, seed):
    r = random.Random(seed)
    graph = {}
    for i in range(8):
        own = {}
        if r.random() < 0.4:
            own["base"] = f"d{i}"
        if r.random() < 0.4:
            own["paths"] = {f"k{i}": [f"v{i}"]}
        graph[f"c{i}.json"] = ([f"c{r.randrange(10)}.json" for _ in range(r.randrange(4))], own)
    files = []
    for name, (bases, own) in graph.items():
        files.append((name, config(extends=[f"./{b}" for b in bases], **({"baseUrl": own["base"]} if "base" in own else {}), **({"paths": own["paths"]} if "paths" in own else {}))))
    got = {x.config: (x.base, x.paths) for x in aliases.effective(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {n: (merged(graph, n).get("base"), merged(graph, n).get("paths")) for n in graph}


def test_broken_and_empty_settings(spark):
    files = {"tsconfig.json": '{"extends": {"a": 1}, "compilerOptions": {"paths": {"x": "no list", "y": [null, 1]}, "baseUrl": 3}}', "a/tsconfig.json": "{ not json", "b/tsconfig.json": '{"compilerOptions": null, "extends": [null, ""]}', "x.ts": ""}
    assert internal(spark, files, specifiers=["x", "y"]) == {}
    assert internal(spark, {}, specifiers=["x"]) == {}
    assert aliases.effective(spark.createDataFrame([], "path string, text string")).count() == 0


def test_the_analysis_hears_of_aliases_and_of_what_is_unread(spark):
    js = "javascript-typescript"
    manifest = '{"dependencies": {"a": "1", "b": "1"}}'
    files = {
        "package.json": '{"dependencies": {"top": "1"}}',
        "one/package.json": manifest, "one/tsconfig.json": config(paths={"a": ["./lib/a"]}), "one/lib/a.ts": "", "one/x.ts": "import 'a'; import 'b';\nimport a from 'a';\nimport b from 'b';",
        "two/package.json": manifest.replace("\"b\"", "\"d\""), "two/.eslintrc.js": "module.exports = {}", "two/inner/package.json": '{"dependencies": {"c": "1"}}',
        "three/package.json": manifest.replace("\"b\"", "\"e\""), "three/x.js": "require(name)",
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {(r.project, r.dependency): r.rule for r in analysed(df).collect() if r.ecosystem == js}
    held = "unverified-no-imports"
    assert got == {(".", "top"): "unused", ("one", "a"): "unused", ("two", "a"): held, ("two", "d"): held, ("two/inner", "c"): held, ("three", "a"): held, ("three", "e"): held}


def test_files_say_which_paths_lead_to_them(spark):
    """A file has a few rows, where each path was made into some thirty files."""
    listed = spark.createDataFrame([("src/a.d.ts",), ("lib/index.ts",)], "file string")
    rows = {(r.file, r.at, r["index"]) for r in aliases._leads(listed).collect()}
    assert ("src/a.d.ts", "src/a", False) in rows and ("src/a.d.ts", "src/a.js", False) in rows
    assert ("lib/index.ts", "lib", True) in rows
    assert len(rows) <= 12

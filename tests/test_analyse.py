from factloom.plans.analyse import analysed

JS = "javascript-typescript"


def findings(spark, files, **kw):
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    return {(r.ecosystem, r.project, r.dependency): (r.kind, r.rule) for r in analysed(df, **kw).collect()}


def test_a_repository(spark):
    files = {
        "package.json": """{"dependencies": {"left-pad": "1", "axios": "1", "@s/used": "2", "lite": "1", "mime": "1", "only-types": "1", "tested": "1", "local": "file:../x", "types-lib": "1"},
            "devDependencies": {"eslint": "9", "typescript": "5", "rimraf2": "1", "@types/types-lib": "1", "@types/ambient": "1", "serve": "1"}, "peerDependencies": {"peer": "1"}, "scripts": {"build": "tsc && rimraf2 dist"}}""",
        "package-lock.json": '{"lockfileVersion": 3, "packages": {"": {"dependencies": {"lite": "1", "mime": "1"}}, "node_modules/lite": {"version": "1", "dependencies": {"mime": "1"}}, "node_modules/mime": {"version": "1"}}}',
        "src/a.ts": "import x from 'axios';\nconst y = require('@s/used/sub');\nimport 'lite';\nimport type { T } from 'only-types';\nimport { z } from 'types-lib';\n",
        "test/a.test.ts": "import t from 'tested';\n",
        ".github/workflows/ci.yml": "jobs:\n  a:\n    steps:\n      - run: npx serve .\n",
        "apps/web/package.json": '{"dependencies": {"axios": "1", "react": "18"}}',
        "apps/web/src/b.js": "import React from 'react';\nimport l from 'left-pad';\n",
        "node_modules/x/package.json": '{"dependencies": {"vendored": "1"}}',
        "svc/requirements.txt": "PyYAML==6\nrequests\nflask-login\n",
        "svc/app.py": "import yaml, os\nfrom flask_login import x\n",
        "go.mod": "module m\nrequire (\n\texample.com/a v1.0.0\n\texample.com/b v1.0.0\n)\n",
        "main.go": 'package main\nimport "example.com/a/sub"\n',
        "crate/Cargo.toml": '[dependencies]\nserde-json = "1"\nrand = "1"\n',
        "crate/src/lib.rs": "use serde_json::Value;\n",
    }
    got = findings(spark, files)
    assert got == {
        (JS, ".", "mime"): ("info", "unverified-no-imports"),
        (JS, ".", "only-types"): ("type-only", "type-only"),
        (JS, ".", "tested"): ("should-be-dev", "should-be-dev"),
        (JS, ".", "@types/ambient"): ("info", "ambient-types-unverified"),
        ("python", "svc", "requests"): ("info", "unverified-no-imports"),
        ("go", ".", "example.com/b"): ("info", "unverified-no-imports"),
        ("rust", "crate", "rand"): ("info", "unverified-no-imports"),
    }


def test_unused_and_nested_projects(spark):
    files = {
        "package.json": '{"dependencies": {"a": "1", "b": "1"}}',
        "pkg/package.json": '{"dependencies": {"b": "1"}}',
        "pkg/x.js": "import a from 'a'; ",
        "y.js": "// require('b')\n",
    }
    assert findings(spark, files) == {(JS, ".", "b"): ("unused", "unused"), (JS, "pkg", "b"): ("unused", "unused")}
    assert findings(spark, files, extra_tools={JS: {"exact": ["b"]}}) == {}
    assert findings(spark, {}) == {}


def test_every_kind_of_lockfile_tells_who_requires(spark):
    declared = '{"dependencies": {"lite": "^1.0.0", "mime": "^2.0.0"}}'
    files = {}
    for folder in ("pnpm", "yarn", "berry", "bun", "old"):
        files |= {f"{folder}/package.json": declared, f"{folder}/a.js": "import 'lite';\n"}
    files |= {
        "pnpm/pnpm-lock.yaml": "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      lite:\n        specifier: ^1.0.0\n        version: 1.0.0\nsnapshots:\n  lite@1.0.0:\n    dependencies:\n      mime: 2.0.0\n  mime@2.0.0: {}\n",
        "yarn/yarn.lock": 'lite@^1.0.0:\n  version "1.0.0"\n  dependencies:\n    mime "^2.0.0"\n\nmime@^2.0.0:\n  version "2.0.0"\n',
        "berry/yarn.lock": '__metadata:\n  version: 6\n\n"lite@npm:^1.0.0":\n  version: 1.0.0\n  dependencies:\n    mime: ^2.0.0\n\n"mime@npm:^2.0.0":\n  version: 2.0.0\n',
        "bun/bun.lock": '{"workspaces": {"": {"dependencies": {"lite": "^1.0.0", "mime": "^2.0.0"}}}, "packages": {"lite": ["lite@1.0.0", "", {"dependencies": {"mime": "^2.0.0"}}, "x"], "mime": ["mime@2.0.0", "", {}, "x"],},}',
        "old/package-lock.json": '{"dependencies": {"lite": {"version": "1.0.0", "requires": {"mime": "^2.0.0"}}, "mime": {"version": "2.0.0"}}}',
        "none/package.json": declared,
        "none/a.js": "import 'lite';\n",
        "r/Cargo.toml": '[dependencies]\nlite = "1"\nmime = "2"\n',
        "r/src/lib.rs": "use lite::X;\n",
        "Cargo.lock": '[[package]]\nname = "lite"\nversion = "1.0.0"\ndependencies = ["mime"]\n[[package]]\nname = "mime"\nversion = "2.0.0"\n',
        "p/pyproject.toml": '[project]\ndependencies = ["Lite>=1", "mi_me"]\n',
        "p/a.py": "import lite\n",
        "p/poetry.lock": '[[package]]\nname = "lite"\nversion = "1"\n[package.dependencies]\nMi_Me = "*"\n[[package]]\nname = "Mi_Me"\nversion = "2"\n',
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {(r.project, r.dependency): (r.rule, r.host) for r in analysed(df).collect()}
    note = ("unverified-no-imports", "lite")
    assert got == {**{(f, "mime"): note for f in ("pnpm", "yarn", "berry", "bun", "old", "r")}, ("p", "mi-me"): note, ("none", "mime"): ("unused", None)}

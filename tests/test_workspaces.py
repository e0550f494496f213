import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.sources import workspaces


def members(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    return {(r.root, r.member): r.status for r in workspaces.javascript_members(df).collect()}


def package(*folders):
    return {f"{f}/package.json": "{}" for f in folders}


def pnpm(*globs):
    return {"pnpm-workspace.yaml": "packages:\n" + "".join(f"  - '{g}'\n" for g in globs)}


@pytest.mark.parametrize(("globs", "want"), [
    (["packages/*", "apps/**"], {"packages/a": "member", "packages/a/b": "nonmember", "apps/x/y/z": "member", "apps": "member", "other": "nonmember"}),
    (["!packages/no", "packages/**"], {"packages/no": "nonmember", "packages/yes": "member", "packages/no/in": "member"}),
    (["packages/*", "**"], {"packages/.hid": "nonmember", ".top/x": "nonmember", "a/b": "member"}),
    (["packages/.hid", "a*/*-b"], {"packages/.hid": "member", "ab/x-b": "member", "b/x-b": "nonmember", "ab/x-bc": "nonmember"}),
    (["packages/**", "!**/test/**"], {"packages/x": "member", "packages/x/test": "nonmember", "packages/test/.y": "nonmember"}),
    (["packages/.hid", "!packages/x"], {"packages/.hid": "unknown", "packages/y": "unknown"}),
    (["packages/**/.x"], {"packages/y": "unknown"}),
    (["../up", "packages/*"], {"packages/y": "unknown"}),
    (["packages/{a,b}"], {"packages/a": "unknown"}),
    (["./packages/*/"], {"packages/a": "member"}),
    (["a.b/*"], {"a.b/x": "member", "axb/x": "nonmember"}),
])
def test_globs(spark, globs, want):
    got = members(spark, pnpm(*globs) | package(*want))
    assert got == {(".", f): s for f, s in want.items()}


def test_forms_of_the_list_and_installed_packages(spark):
    files = {
        "a/pnpm-workspace.yaml": "# x\npackages: # none\n\n- \"p/*\" # p\n- r # q\nkeep: true\n- s\n", "b/pnpm-workspace.yaml": "packages: ['p/*', \"q\"]\n", "c/package.json": '{"workspaces": ["p/*"]}', "d/package.json": '{"workspaces": {"packages": ["p/*"], "nohoist": ["**"]}}',
        "e/package.json": '{"workspaces": ["q"]}', "e/pnpm-workspace.yaml": "packages:\n  - p/*\n", "f/pnpm-workspace.yaml": "packages: 3\n",
    }
    files |= package(*(f"{x}/{y}" for x in "abcdef" for y in ("p/1", "q", "r", "s", "p/node_modules/z")))
    got = {k: v for k, v in members(spark, files).items() if v == "member"}
    assert set(got) == {("a", "a/p/1"), ("a", "a/r"), ("b", "b/p/1"), ("b", "b/q"), ("c", "c/p/1"), ("d", "d/p/1"), ("e", "e/p/1")}


def by_hand(pattern, folder):
    """A glob of the third kind (dots are ordinary) by recursion."""
    def walk(p, f):
        if not p:
            return not f
        if p[0] == "**":
            return walk(p[1:], f) or bool(f) and walk(p, f[1:])
        return bool(f) and fits(p[0], f[0]) and walk(p[1:], f[1:])

    def fits(glob, name):
        if not glob:
            return not name
        if glob[0] == "*":
            return fits(glob[1:], name) or bool(name) and fits(glob, name[1:])
        if glob[0] == "[":
            end = glob.index("]", 2)
            body, negated = (glob[2:end], True) if glob[1] == "!" else (glob[1:end], False)
            return bool(name) and bool(re.match(f"[{body}]", name[0])) != negated and fits(glob[end + 1 :], name[1:])
        return bool(name) and glob[0] in ("?", name[0]) and fits(glob[1:], name[1:])

    return walk([s for s in pattern.split("/") if s not in ("", ".")], [] if folder == "." else folder.split("/"))


def test_globs_against_recursion(spark):
    r = random.Random(2)
    segment = lambda of: "".join(r.choice(of) for _ in range(r.randrange(1, 4)))
    folders = sorted({"/".join(segment("ab.") for _ in range(r.randrange(1, 4))) for _ in range(150)} | {"."})
    globs = sorted({"/".join(r.choice([segment(["a", "b", "*", "?", ".", "[ab]", "[!a]", "[a-b]"]), "**"]) for _ in range(r.randrange(1, 4))) for _ in range(120)})
    df = lambda c, xs: spark.createDataFrame([(h, x) for h in ("r", "q") for x in xs], f"root string, {c} string")
    got = {(x.root, x.glob, x.folder) for x in workspaces.matched(df("glob", globs).withColumn("dots", F.lit(True)), df("folder", folders)).collect()}
    assert got == {(h, g, f) for h in ("r", "q") for g in globs for f in folders if by_hand(g, f)}
    assert len(got) > 300


def test_broken_globs_match_nothing(spark):
    globs = spark.createDataFrame([(".", g, True) for g in ("a[", "a[b", "{a,b}", "[]", "a]")], "root string, glob string, dots boolean")
    folders = spark.createDataFrame([(".", f) for f in ("a", "ab", "a[", "a]", "{a,b}")], "root string, folder string")
    assert {(r.glob, r.folder) for r in workspaces.matched(globs, folders).collect()} == {("a]", "a]")}


def cargo(spark, files):
    df = spark.createDataFrame([(f"{k}/Cargo.toml" if k else "Cargo.toml", v) for k, v in files.items()], "path string, text string")
    return {(r.root, r.member) for r in workspaces.cargo_members(workspaces.crates(df)).collect()}


def test_cargo_members(spark):
    crate = '[package]\nname = "x"\n'
    files = {
        "": '[workspace]\nmembers = ["crates/*", "one"]\nexclude = ["crates/out", "far"]\n' + crate, "crates/a": crate + '[dependencies]\nlinked = { path = "../../linked" }\nfar = { path = "../../far" }\n', "crates/out": crate, "crates/out/deep": crate, "one": crate,
        "linked": crate + '[dev-dependencies]\nnext = { path = "next" }\nback = { path = "../crates/a" }\n', "linked/next": crate, "far": crate, "alone": crate, "crates/virtual": "[profile]\n", "crates/own": crate + "[workspace]\n", "crates/own/in": crate, "broken": "[package\n",
        "crates/up": crate.replace('"x"\n', '"x"\nworkspace = "../own"\n'),
    }
    assert cargo(spark, files) == {(".", "."), (".", "crates/a"), (".", "one"), (".", "linked"), (".", "linked/next"), ("crates/own", "crates/own")}
    assert cargo(spark, {}) == set()


def test_inherited_dependencies(spark):
    files = {"Cargo.toml": '[workspace]\nmembers = ["a"]\n[workspace.dependencies]\nx = "1"\ny = { git = "https://h/y" }\n', "a/Cargo.toml": '[package]\nname = "a"\n[dependencies]\nx.workspace = true\ny = { workspace = true, optional = true }\nz = { workspace = true }\nw = "1"\n'}
    got = workspaces.inherited_dependencies(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert {(r.member, r.key, r.name, r.constraint) for r in got.collect()} == {("a", "x", "x", "1"), ("a", "y", "y", "*"), ("a", "z", None, None)}


def gates(spark, features, optional):
    rows = [("c", None, k) for k in optional] + [("c", f, i) for f, items in features.items() for i in items or [None]]
    df = workspaces.feature_gates(spark.createDataFrame(rows, "crate string, feature string, item string"))
    out = {}
    for r in df.collect():
        out.setdefault(r.key, set()).update([r.feature] if r.feature else [])
    return out


def slow_gates(features, optional):
    def on(feature):
        """Keys that a feature turns on, by rounds until nothing changes."""
        hidden = {i[4:] for items in features.values() for i in items if i.startswith("dep:")}
        active, keys, before = {feature}, set(), None
        while before != (len(active), len(keys)):
            before = (len(active), len(keys))
            for f in list(active):
                if f not in features and f in optional and f not in hidden:
                    keys.add(f)
                for i in features.get(f, []):
                    if i.startswith("dep:"):
                        keys.add(i[4:])
                    elif "/" in i:
                        keys.update([] if i.split("/")[0].endswith("?") else [i.split("/")[0]])
                    else:
                        active.add(i)
                        keys.update([i] if i in optional and i not in features else [])
        return keys & set(optional)

    return {k: {f for f in {*features, *optional} if k in on(f)} for k in optional}


@pytest.mark.parametrize("seed", range(4))
def test_feature_gates_on_random_features(spark, seed):
    r = random.Random(seed)
    optional = [f"k{i}" for i in range(5)]
    names = [f"f{i}" for i in range(6)] + r.sample(optional, 2)
    item = lambda: r.choice([r.choice(names), "dep:" + r.choice(optional), r.choice(optional), r.choice(optional) + "/x", r.choice(optional) + "?/x", "std"])
    features = {n: [item() for _ in range(r.randrange(4))] for n in names}
    assert gates(spark, features, optional) == slow_gates(features, optional)

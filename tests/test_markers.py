import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import markers
from factloom.sources import pythons


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", f(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect(), key=lambda r: r.i)]


GOOD = ["os_name == 'nt'", "'nt'==os_name", "python_version>='3.8' and extra == 'x'", "(os_name=='a' or os_name=='b') and ('x' in sys.platform)", "extra not in \"a b\"", "((((extra=='a'))))", "'a' == 'b'", "extra not\tin 'x'", "python_version ~= '3' or os.name === 'x' and extra < 'y'"]
BAD = ["", " ", "os_name", "os_name ==", "== 'x'", "nope == 'x'", "os_name = 'x'", "os_name == 'x", "os_name == 3", "(os_name == 'x'", "os_name == 'x')", "os_name == 'x' and", "and os_name == 'x'", "os_name == 'x' os_name == 'x'", "os_name == 'x' == 'y'", "not os_name == 'x'", "os_name not 'x'", "()", "os_name == 'x' & extra == 'y'", "(" * 65 + "extra == 'a'" + ")" * 65, None]


def test_markers(spark):
    assert values(spark, markers.is_marker, GOOD) == [True] * len(GOOD)
    assert values(spark, markers.is_marker, BAD) == [False] * len(BAD)
    assert values(spark, markers.is_marker, ["(" * 64 + "extra == 'a'" + ")" * 64]) == [True]


def grammar(tokens):
    """Whether tokens are a marker, by recursive descent."""
    def either(i):
        i = one(i)
        while i is not None and i < len(tokens) and tokens[i] in ("and", "or"):
            i = one(i + 1)
        return i

    def one(i):
        if i < len(tokens) and tokens[i] == "(":
            i = either(i + 1)
            return i + 1 if i is not None and i < len(tokens) and tokens[i] == ")" else None
        good = len(tokens) >= i + 3 and tokens[i] in ("extra", "'x'") and tokens[i + 1] in ("==", "in") and tokens[i + 2] in ("extra", "'x'")
        return i + 3 if good else None

    return either(0) == len(tokens)


def test_markers_against_descent(spark):
    r = random.Random(1)
    few = [list(x) for n in (1, 3, 5) for x in itertools.product(["extra", "==", "(", ")"], repeat=n)]
    base = ["extra", "==", "'x'"]
    def grown(depth):
        if depth == 0:
            return base
        return r.choice([lambda: ["(", *grown(depth - 1), ")"], lambda: [*grown(depth - 1), r.choice(["and", "or"]), *grown(depth - 1)], lambda: grown(depth - 1)])()

    more = [grown(4) for _ in range(150)]
    for x in [list(x) for x in more]:
        y = list(x)
        y[r.randrange(len(y))] = r.choice(["(", ")", "and", "in", "extra"])
        more.append(y)
    all_ = few + more
    assert values(spark, markers.is_marker, [" ".join(x) for x in all_]) == [grammar(x) for x in all_]


def test_markers_without_parentheses(spark):
    """One pattern knows them, and says what the tokens say, which parentheses lead to."""
    r = random.Random(2)
    pieces = ["os_name", "os.name", "os_namex", "extra", "'x'", '"a b"', "'x", "==", "===", "=", "<", "<=", "~=", "in", "not in", "not\n in", "not", "and", "or", "andx", "3"]
    good = lambda: [r.choice(pieces[:2] + pieces[3:6]), r.choice(["==", "===", "<", "in", "not in", "not\n in"]), r.choice(pieces[:2] + pieces[3:6])]
    tokens = [list(x) for n in (1, 2, 3) for x in itertools.product(pieces[:10], repeat=n)]
    for _ in range(1500):
        x = good()
        while r.random() < 0.5:
            x += [r.choice(["and", "or"]), *good()]
        if r.random() < 0.5:
            x[r.randrange(len(x))] = r.choice(pieces)
        tokens.append(x)
    texts = ["".join(t + r.choice(["", " ", " ", "\t\n"]) for t in x) for x in tokens] + ["os_name == 'x'\u2028", "os_name == 'x'\u0085", "\u00a0os_name == 'x'"]
    got = values(spark, markers.is_marker, texts)
    assert got == values(spark, markers.is_marker, [f"({t})" for t in texts])
    known = values(spark, lambda t: t.rlike(markers.PLAIN), texts)
    assert known == got and 300 < sum(got) < len(got) - 300
    long = " and ".join(["os_name == 'x'"] * 20000)
    assert values(spark, markers.is_marker, [long]) == [True]


def test_merged(spark):
    rows = [(["a", "b", "a"],), (["a"],), (["a", "a"],), (["a", None],), ([],), (["a", "b", "c"],), (None,)]
    df = spark.createDataFrame(rows, "m array<string>").select(markers.merged(F.col("m")).alias("y"))
    assert [r.y for r in df.collect()] == ["(a) or (b)", "a", "a", None, None, "((a) or (b)) or (c)", None]


@pytest.mark.parametrize(("text", "want"), [
    (">=3.8", ([3, 8, 0], False)), (">=3.0", ([3, 0, 0], False)), (">=3.10", ([3, 10, 0], False)), (">3.8", ([3, 8, 0], True)), (">=3.8,<4", ([3, 8, 0], False)), (">=3.8 <4", ([3, 8, 0], False)), (">=3.8, >=3.10", ([3, 10, 0], False)), (">=3.8,>3.8", ([3, 8, 0], True)), ("^3.8", ([3, 8, 0], False)), ("~3.8.1", ([3, 8, 1], False)),
    ("~=3.8", ([3, 8, 0], False)), ("==3.9.*", ([3, 9, 0], False)), ("==3.9", ([3, 9, 0], False)), ("==3", None), ("3.8", ([3, 8, 0], False)), (">=3.8 || >=2.7", ([2, 7, 0], False)), (">3 || >=3", ([3, 0, 0], False)), (">=3.8 || <4", None), ("<4", None), ("!=3.8", None),
    (">=3.8,!=3.8", None), (">=3.8,!=3.8.0", None), (">=3.8,!=3.9", ([3, 8, 0], False)), (">3.8,!=3.8", ([3, 8, 0], True)), (">=3.8,<3.8", None), (">=3.8,<=3.8", ([3, 8, 0], False)), (">3.8,<=3.8", None), ("^3.8,>=4", None), ("~3.8,>=3.9", None), ("~3,>=3.9", ([3, 9, 0], False)),
    ("~=3.8,>=3.9", ([3, 9, 0], False)), ("~=3.8.1,>=3.9", None), ("~=3", None), ("^0.5,>=0.6", None), ("==3.*,>=3.4", ([3, 4, 0], False)), ("==3.8.*,>=3.9", None), (">=3.8.*", None), (">=3.8,", None), ("", None), ("junk", None), (">=3.8 |", None), (">=3.8rc1", None), (None, None),
])
def test_floors(spark, text, want):
    got = values(spark, markers.floor, [text])[0]
    assert (got and (got.version, got.exclusive)) == want


def test_floors_of_projects(spark):
    files = {
        "a/pyproject.toml": '[project]\nrequires-python = ">=3.9"\n[tool.poetry.dependencies]\npython = "^3.8"\n', "b/pyproject.toml": '[tool.poetry.dependencies]\npython = { version = "^3.8" }\n', "c/setup.py": "setup(\n  python_requires='>=3.7',\n)", "c/setup.cfg": "[options]\npython_requires = >=3.6\n",
        "d/setup.py": "setup(python_requires=x)", "d/setup.cfg": "[metadata]\nname = d\n[options]\nzip_safe = no\npython_requires = >=3.6\n", "e/pyproject.toml": "[project\n", "e/setup.cfg": "[options]\npython_requires = >=3.6\n", "f/setup.py": "setup(python_requires=x)", "g/pyproject.toml": "[project]\n",
        "h/pyproject.toml": '[project]\nrequires-python = 3\n', "h/setup.cfg": "[options]\npython_requires = >=3.6\n", "i/setup.cfg": "[options]\nx = 1\n[other]\npython_requires = >=3.6\n",
    }
    got = {r.project: (r.status, r.version, r.place) for r in pythons.floors(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {
        "a": ("declared", "3.9.0", "requires-python"), "b": ("declared", "3.8.0", "poetry python"), "c": ("declared", "3.7.0", "setup.py"), "d": ("declared", "3.6.0", "setup.cfg"), "e": ("unparsed", None, "requires-python"), "f": ("unparsed", None, "setup.py"),
        "g": ("absent", None, None), "h": ("unparsed", None, "requires-python"), "i": ("absent", None, None),
    }


def test_extras_and_conditions(spark):
    text = '[project]\nname = "Pkg"\ndependencies = ["x ; os_name == \'nt\'", "X;extra==\'y\'", "z", "z ; os_name == \'nt\'", "bad ; nope"]\n[project.optional-dependencies]\na = ["q", "pkg[B,c]"]\nb = ["r", "PKG[a]"]\nc = ["pkg[none]"]\nD = []\n'
    df = spark.createDataFrame([("pyproject.toml", text), ("w/pyproject.toml", None), ("v/pyproject.toml", "[project]\noptional-dependencies = 3\n")], "path string, text string")
    assert {(r.extra, r.name) for r in pythons.extras(df).collect()} == {("a", "q"), ("a", "r"), ("b", "r"), ("b", "q"), ("c", None), ("d", None)}
    got = {(r.extra, r.name): (r.valid, r.marker) for r in pythons.conditions(df).collect()}
    assert got[None, "x"] == (True, "(extra=='y') or (os_name == 'nt')") and got[None, "z"] == (True, None) and got[None, "bad"] == (False, None) and got["a", "q"] == (True, None)


def test_a_requirement_said_again_is_one_row(spark):
    text = '[project]\ndependencies = ["x ; os_name == \'nt\'", "x ; os_name == \'nt\'", "y", "x"]\n[project.optional-dependencies]\na = ["x", "x"]\n'
    df = spark.createDataFrame([("a/pyproject.toml", text), ("b/pyproject.toml", text), ("c/pyproject.toml", None)], "path string, text string")
    got = sorted((r.project, r.extra or "", r.text) for r in pythons.listed(df).where("section = 'requirement'").collect())
    assert got == [(p, e, t) for p in ("a", "b") for e, t in (("", "x"), ("", "x ; os_name == 'nt'"), ("", "y"), ("a", "x"))]
    assert [r.section for r in pythons.listed(df).where("project = 'c'").collect()] == ["name"]
    assert sorted((r.project, r.extra or "", r.text) for r in pythons.listed(df, "requirement").collect()) == got
    found = {(r.project, r.extra, r.name): (r.valid, r.marker) for r in pythons.conditions(df).collect()}
    assert found == {(p, e, n): (True, None) for p in ("a", "b") for e, n in ((None, "x"), (None, "y"), ("a", "x"))}


def test_names_are_what_the_whole_pattern_finds(spark):
    texts = ["x", " A.b_c- >1", "a-", "a[x;y] >1 ; m", "a [x] ; m\n", "a ; m\nn", "a;b;c", "a-;\nb\nc", "-a", "", ";", "a_-.b", "a b", "a\n", "a[x", "a]; ", "\u00e9a", "a\u00e9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    part = lambda i: F.regexp_extract("text", pythons.REQUIREMENT, i)
    for r in df.select("text", part(1).alias("n"), part(4).alias("m"), F.regexp_extract("text", pythons.NAME, 1).alias("alone")).collect():
        assert (r.n == "" or r.n == r.alone) and (r.m == "" or ";" in r.text), r


def test_files_are_dealt_over_all_shuffle_partitions(spark, tmp_path):
    """Few bytes make few partitions if left to their size, though a file is much work."""
    from factloom.plans import evidence

    rows = [(o, p, n, "ANRAR"[n]) for o in range(40) for n, p in enumerate((1, 1, 1, 2, 2))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = evidence.merged_markers(spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in plan
    both = "(os_name == 'nt') or (python_version < '3')"
    assert sorted((r.project, r.name, r.marker) for r in made.collect()) == sorted((f"o{o}", n, m) for o in range(40) for n, m in (("part-1", None), ("part-2", both)))

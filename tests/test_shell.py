import pytest

from factloom.functions import shell
from factloom.sources import references


@pytest.mark.parametrize(("script", "want"), [
    ("tsc -p . && eslint src || true; prettier x | tee log & wait", ["tsc", "eslint", "true", "prettier", "tee", "wait"]),
    ("NODE_ENV=x A='b c' jest --ci", ["jest"]), ("tsc \\\n  --build && \\\r\n vite", ["tsc", "vite"]), ("npx -p typescript tsc", ["tsc"]), ("pnpm exec -- eslint .", ["eslint"]), ("env -u HOME FOO=1 mocha", ["mocha"]), ("cross-env A=1 B=2 webpack", ["webpack"]),
    ("sudo -u me nice -n 5 rollup -c", ["rollup"]), ("find . | xargs -n 1 rimraf", ["find", "rimraf"]), ("sh -c 'tsc && ava'", ["sh", "tsc", "ava"]), ("bash -ec \"sh -c 'a b' ; c\"", ["bash", "sh", "a", "c"]), ("concurrently \"tsc -w\" 'vite dev' --kill-others", ["concurrently", "tsc", "vite"]),
    ("cross-env-shell A=1 \"b && c\"", ["cross-env-shell", "b", "c"]), ("if test -f x; then a; else b; fi; ! c; { d; }", ["test", "a", "b", "c", "d"]), ("for x in a b; do lint $x; done", ["lint"]), ("while a; do b; done", ["a", "b"]), ("a # b && c\nd", ["a", "d"]), ("a 'x # y' z#w && b \\# c", ["a", "b"]),
    ("a > out 2>&1 < in >> log b && c &> d e", ["a", "c"]), ("(cd x && b)", ["cd", "b"]), ("'my tool' x", ["my tool"]), ("a;;b", ["a", "b"]), ("", []), ("   ", []), ("# only", []), (None, []), ("echo \"a && b\" 'c; d'", ["echo"]), ("A=1", []), ("\"if\" x", ["if"]),
])
def test_commands(script, want):
    assert shell.commands(script)[0] == want


@pytest.mark.parametrize(("script", "gaps"), [
    ("a 'b", ["unterminated quote"]), ("$TOOL x", ["computed command"]), ("a $(b c)", ["substitution"]), ("`a` b", ["substitution", "computed command"]), ("a $(b", ["unterminated substitution", "substitution"]), ("cat <<EOF\nx\nEOF", ["here-document"]), ("sh -c \"$X\"", ["computed command"]), ("a $X '$(b)'", []),
    ("\"$(a ')' \\) \"x)\" y)\" z", ["substitution", "computed command"]),
])
def test_gaps(script, gaps):
    assert shell.commands(script)[1] == gaps


def test_deep_nesting_ends():
    script = "x"
    for _ in range(12):
        script = "sh -c " + "'" + script.replace("'", "'\\''") + "'"
    found, gaps = shell.commands(script)
    assert found == ["sh"] * (shell.NESTING + 1) and gaps == ["nested too deep"]


def test_scripts_of_a_table(spark):
    rows = [("p", "build", "NODE_ENV=x npx tool --fast && ./bin/x.sh"), ("p", "odd", "$X && 'a b'"), ("p", "none", None)]
    df = spark.createDataFrame(rows, "path string, name string, script string")
    assert sorted((r.name, r.command) for r in references.commands(df).collect()) == [("build", "./bin/x.sh"), ("build", "tool"), ("odd", "a")]
    assert [(r.name, r.reason) for r in references.script_gaps(df).collect()] == [("odd", "computed command")]
    assert references.commands(df.where("false")).count() == 0

import inspect
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import aggregates, budgets, graph, joins, rules
from factloom.streaming import queue


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# Rules

DEPENDENCIES = "ecosystem string, project string, name string, kind string, declared_in string, specifier_type string"
USAGES = "dependency string, file string, form string, via string, type_only boolean, removed_in_pr boolean"
CLOSURE = "ecosystem string, project string, direct string, member string"
JS = "javascript-typescript"


def found(spark, names, usages=(), closure=(), peers=(), open_peers=(), analysed=((JS, True, True), ("python", True, False)), pull_request=False):
    rows = [(e, ".", n, k, f"{e}.manifest", s) for e, n, k, s in names]
    df = rules.findings(
        spark.createDataFrame(rows, DEPENDENCIES), spark.createDataFrame(list(usages), USAGES), spark.createDataFrame(list(closure), CLOSURE), spark.createDataFrame(list(peers), CLOSURE), spark.createDataFrame(list(open_peers), CLOSURE),
        spark.createDataFrame(list(analysed), "ecosystem string, usages_analysed boolean, references_analysed boolean"), F.col("name").isin("eslint") | F.startswith("name", F.lit("eslint-plugin-")), paths.is_non_shipped(F.col("file")), pull_request,
    )
    return {(r.ecosystem, r.dependency): (r.kind, r.rule, r.severity, r.confidence, r.host) for r in df.collect()}


def test_unused_and_what_prevents_it(spark):
    names = [(JS, n, "runtime", "registry") for n in ("left", "used", "needed", "hosted", "eslint", "eslint-plugin-x")] + [(JS, "peer", "peer", "registry"), (JS, "git", "runtime", "git"), (JS, "opt", "optional", None), ("python", "left", "runtime", "registry"), ("go", "left2", "runtime", "registry")]
    got = found(spark, names, [("used", "src/a.js", "static", "import", False, False)], [(JS, ".", "used", "needed"), (JS, ".", "left", "left")], [(JS, ".", "used", "hosted")])
    assert got == {
        (JS, "left"): ("unused", "unused", "medium", "medium", None),
        (JS, "needed"): ("info", "unverified-no-imports", "info", "low", "used"),
        (JS, "hosted"): ("info", "unverified-no-imports", "info", "low", "used"),
        ("python", "left"): ("info", "unverified-no-imports", "info", "low", None),
    }


def test_peer_host_goes_before_open_peer_and_closure(spark):
    got = found(spark, [(JS, "x", "runtime", None)], closure=[(JS, ".", "x", "y"), (JS, ".", "c", "x")], peers=[(JS, ".", "p", "x")], open_peers=[(JS, ".", "o", "x")])
    assert got[JS, "x"][-1] == "p"


def test_types(spark):
    names = [(JS, "@types/node", "dev", None), (JS, "@types/a__b", "dev", None), (JS, "@a/b", "runtime", None), (JS, "@types/used", "dev", None)]
    usages = [("@a/b", "src/a.ts", "static", "import", True, None), ("@types/used", "src/a.ts", "static", "import", True, None)]
    got = found(spark, names, usages)
    assert got == {(JS, "@types/node"): ("info", "ambient-types-unverified", "info", "low", None), (JS, "@a/b"): ("type-only", "type-only", "low", "medium", None)}


def test_should_be_dev_and_rule_order(spark):
    use = lambda n, f, v="import", t=False: (n, f, "static", v, t, False)
    names = [(JS, n, "runtime", None) for n in ("tested", "shipped", "script", "typed")] + [(JS, "dev", "dev", None)]
    usages = [use("tested", "test/a.js"), use("tested", "src/b.test.ts"), use("shipped", "test/a.js"), use("shipped", "src/a.js"), use("script", "package.json", "script"), use("typed", "test/a.ts", t=True), use("dev", "test/a.js")]
    got = found(spark, names, usages)
    assert got == {(JS, "tested"): ("should-be-dev", "should-be-dev", "low", "medium", None), (JS, "typed"): ("type-only", "type-only", "low", "medium", None)}


def test_removed_last_usage(spark):
    names = [(JS, "gone", "runtime", None), (JS, "both", "runtime", None), (JS, "never", "runtime", None)]
    usages = [("gone", "a.js", "static", "import", False, True), ("both", "a.js", "static", "import", False, True), ("both", "b.js", "static", "import", False, False)]
    assert found(spark, names, usages, pull_request=True) == {(JS, "gone"): ("unused", "removed-last-usage", "medium", "medium", None), (JS, "never"): ("unused", "unused", "medium", "medium", None)}
    assert found(spark, names, usages)[JS, "gone"][1] == "unused"


@pytest.mark.parametrize(("kind", "confidence", "want"), [("unused", "high", "medium"), ("unused", "medium", "low"), ("unused", "low", "info"), ("footprint", "high", "low"), ("footprint", "low", "info"), ("info", "high", "info"), ("other", "high", "info")])
def test_severity(spark, kind, confidence, want):
    df = spark.createDataFrame([(kind, confidence)], "k string, c string")
    assert df.select(rules.severity(F.col("k"), F.col("c"))).first()[0] == want


# Graphs


def brute_closure(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for start in ahead:
        seen, stack = set(), [start]
        while stack:
            for y in ahead.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        out |= {(start, y) for y in seen if y != start}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_with_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(25), r.randrange(25)) for _ in range(40)] + [(7, 7), (None, 1)]
    df = spark.createDataFrame(edges, "src int, dst int")
    assert set(tuples(graph.closure(df))) == brute_closure([e for e in edges if e[0] is not None])
    starts = spark.createDataFrame([(3,), (7,)], "src int")
    assert set(tuples(graph.closure(df, starts=starts))) == {e for e in brute_closure([e for e in edges if e[0] is not None]) if e[0] in (3, 7)}


def test_no_edges(spark):
    assert graph.closure(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_exclusive_reach(spark):
    reach = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("a", "b")], "src string, dst string")
    assert tuples(graph.exclusive_reach(reach)) == [("a", 3, 1), ("b", 1, 0)]


# Joins


def test_nearest_ancestor_prefix_traps(spark):
    items = spark.createDataFrame([("a/b/c",), ("a-b",), ("ab",), (".",), ("a/b/c",)], "dir string")
    roots = spark.createDataFrame([("a", 1), ("a/b", 2), (".", 3)], "root string, n int")
    assert tuples(joins.nearest_ancestor(items, roots, "dir", "root"), "dir", "n") == [(".", 3), ("a-b", 3), ("a/b/c", 2), ("a/b/c", 2), ("ab", 3)]
    assert tuples(joins.nearest_ancestor(items, roots.where("n < 3"), "dir", "root", strict=True), "dir", "n") == [(".", None), ("a-b", None), ("a/b/c", 2), ("a/b/c", 2), ("ab", None)]


def test_nearest_ancestor_tie(spark):
    items = spark.createDataFrame([("a/x",)], "dir string")
    roots = spark.createDataFrame([("a", "rust"), ("a", "go"), (".", "go")], "root string, eco string")
    assert tuples(joins.nearest_ancestor(items, roots, "dir", "root", order=[F.col("eco")]), "root", "eco") == [("a", "go")]


def test_longest_prefix(spark):
    items = spark.createDataFrame([("x.com/a/b",), ("x.com/ab",), ("y",)], "path string")
    modules = spark.createDataFrame([("x.com/a",), ("x.com",)], "module string")
    assert tuples(joins.longest_prefix(items, modules, "path", "module")) == [("x.com/a/b", "x.com/a"), ("x.com/ab", "x.com"), ("y", None)]


def test_range_overlap(spark):
    spans = spark.createDataFrame([("f", 1, 9), ("f", 10, 10), ("g", 1, 500)], "file string, low int, high int")
    points = spark.createDataFrame([("f", 10), ("g", 499), ("g", 501)], "file string, line int")
    assert tuples(joins.range_overlap(spans, points, ["file"], "low", "high", "line", 16)) == [("f", 10, 10), ("g", 1, 500)]


def test_snapshot_diff_and_moves(spark):
    row = "name string, kind string, v string"
    base = spark.createDataFrame([("a", "dev", "1"), ("b", "runtime", None), ("c", "dev", "1")], row)
    head = spark.createDataFrame([("a", "runtime", "1"), ("b", "runtime", None), ("c", "dev", "2")], row)
    diff = joins.snapshot_diff(base, head, ["name", "kind"], "v")
    assert tuples(diff, "name", "kind", "change") == [("a", "dev", "removed"), ("a", "runtime", "added"), ("c", "dev", "changed")]
    assert tuples(joins.moved_pairs(diff, "name", "kind")) == [("a", "dev", "runtime")]


# Aggregates and budgets


def test_cap_with_remainder(spark):
    rows = spark.createDataFrame([("p", f"s{i:03}") for i in range(12)] * 2, "project string, s string")
    assert aggregates.capped(rows, ["project", "s"], 12, "s").count() == 12
    got = tuples(aggregates.capped(rows, ["project", "s"], 10, "s"), "project", "s")
    assert len(got) == 11 and (None, "2 more") in got


@pytest.mark.parametrize("most", [0, 1, 10, 99, 100, 101, 5050, 9999])
def test_prefix_cut(spark, most):
    rows = spark.createDataFrame([(i, 100 - i) for i in range(100)], "i int, n int")
    want, run = [], 0
    for i in range(100):
        run += 100 - i
        if run > most:
            break
        want.append(i)
    assert sorted(r.i for r in budgets.prefix_cut(rows, "i", "n", most, 7).collect()) == want


def test_greedy_fit_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", 1, 6), ("g", 2, 7), ("g", 3, 4), ("h", 1, 11)], "g string, i int, n long")
    assert tuples(budgets.greedy_fit(rows, "g", "i", "n", 10)) == [("g", 2, 10), ("h", 0, 0)]


def test_footprint_needs_all_versions(spark):
    rows = spark.createDataFrame([("a", "x", 5.0), ("a", "x", 3.0), ("a", "y", None), ("a", "y", 9.0), ("b", "z", None)], "e string, n string, s double")
    assert [(e, None if b is None else float(b), s, t) for e, b, s, t in tuples(aggregates.footprint(rows, "e", "n", "s"))] == [("a", 3.0, 1, 2), ("b", None, 0, 1)]


def test_completeness(spark):
    projects = spark.createDataFrame([("n", 1), ("p", 2), ("p", 3), ("c", 4), ("i", 5)], "g string, k int")
    graphs = spark.createDataFrame([(2, False), (4, False), (5, True)], "k int, incomplete boolean")
    assert tuples(aggregates.graph_completeness(projects, graphs, ["k"], "g")) == [("c", "complete"), ("i", "partial"), ("n", "none"), ("p", "partial")]


def test_capabilities(spark):
    declared = spark.createDataFrame([(JS, "axios"), (JS, "got"), ("python", "requests"), (JS, "jest"), ("python", "pytest"), (JS, "zod")], "ecosystem string, name string")
    rows = declared.join(aggregates.capability_catalogue(spark), ["ecosystem", "name"])
    assert tuples(aggregates.overlaps(rows.where("across"), "cluster", "ecosystem", "name"), "name") == [("axios",), ("got",), ("requests",)]
    assert tuples(aggregates.overlaps(rows, "cluster", "ecosystem", "name", across=False), "name") == [("axios",), ("got",)]


# The queue


def test_rate_limit(spark):
    events = spark.createDataFrame([("r", s) for s in (0, 59, 60, 61, 119, 120, 500)] + [("q", 5)], "repo string, s long")
    assert set(tuples(queue.rate_limited(events, "repo", "s", 60))) == {("q", 5), ("r", 0), ("r", 60), ("r", 120), ("r", 500)}


def test_superseded(spark):
    jobs = spark.createDataFrame([("p", 1, "h1", "h0"), ("p", 2, "h2", "h1"), ("p", 3, "h9", "h8")], "pr string, i int, head string, before string")
    assert tuples(queue.superseded(jobs, ["pr"], ["i"], "head", "before"), "i") == [(1,)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "k1", "2024-01-01 00:00:00"), ("a", "k1", "2024-01-01 00:01:00"), ("b", "k2", "2024-01-01 00:00:30"), ("a", "k3", "2024-01-01 00:00:40")], "repo string, key string, at string")
    rows.withColumn("at", F.to_timestamp("at")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("repo string, key string, at timestamp").parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert tuples(run(queue.deduplicated_stream(stream(), ["repo", "key"], "at"), "dedupe", "append"), "repo", "key") == [("a", "k1"), ("a", "k3"), ("b", "k2")]
    assert tuples(run(queue.notices_stream(stream(), "repo", "at"), "notices", "complete"), "repo", "jobs") == [("a", 3), ("b", 1)]


def test_greedy_fit_equals_a_fold_and_holds_no_group(spark):
    r = random.Random(3)
    rows = [(g, i, r.choice([0, 1, 2, r.randrange(900), None])) for g in ("a", "b", None) for i in range(400)] + [("c", i, 500 - i // 2 if i % 2 else 1) for i in range(300)] + [("d", 1, 5000), ("e", 1, 1000), ("e", 2, 0)]
    r.shuffle(rows)
    want = {}
    for g, _, n in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        taken, spent = want.get(g, (0, 0))
        want[g] = (taken + 1, spent + n) if n is not None and spent + n <= 1000 else (taken, spent)
    got = budgets.greedy_fit(spark.createDataFrame(rows, "g string, i int, n long"), "g", "i", "n", 1000)
    assert {x.g: (x.taken, x.spent) for x in got.collect()} == want
    assert "collect_list" not in inspect.getsource(budgets.greedy_fit)
    with pytest.raises(Exception, match="negative"):
        budgets.greedy_fit(spark.createDataFrame([("a", 1, -1)], "g string, i int, n long"), "g", "i", "n", 9).collect()
    assert budgets.greedy_fit(spark.createDataFrame([], "g string, i int, n long"), "g", "i", "n", 9).count() == 0


@pytest.mark.parametrize("gap", [0, 1, 7, 60])
def test_rate_limits_equal_a_fold_and_hold_no_key(spark, gap):
    r = random.Random(gap)
    rows = [("hot", r.randrange(-500, 3000)) for _ in range(3000)] + [(None, r.randrange(100)) for _ in range(40)] + [(f"k{i}", r.randrange(90)) for i in range(30)] + [("none", None)]
    want, last = set(), {}
    for k, s in sorted({x for x in rows if x[1] is not None}, key=lambda x: (str(x[0]), x[1])):
        if k not in last or s - last[k] >= gap:
            want.add((k, s))
            last[k] = s
    got = tuples(queue.rate_limited(spark.createDataFrame(rows, "repo string, s long"), "repo", "s", gap))
    assert len(got) == len(want) and set(got) == want
    assert "collect_list" not in inspect.getsource(queue.rate_limited)


def test_closure_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: written.append(stored(df)) or written[-1])
    edges = spark.range(1000).selectExpr("id AS src", "id + 1 AS dst")
    reach = graph.closure(edges, starts=spark.createDataFrame([(0,), (990,)], "src long"))
    assert reach.groupBy("src").count().collect() and {(r.src, r["count"]) for r in reach.groupBy("src").count().collect()} == {(0, 1000), (990, 10)}
    assert len(written) <= 12


def test_closure_rounds_end_on_cycles_with_tails(spark):
    edges = [(i, (i + 1) % 7) for i in range(7)] + [(3, 10), (10, 11), (11, 12), (12, 3), (12, 13), (5, 5), (20, 21)]
    assert set(tuples(graph.closure(spark.createDataFrame(edges, "src int, dst int")))) == brute_closure(edges)


@pytest.mark.parametrize("most", [0, 9, 10, 11, 55, 1000])
def test_prefix_cut_equals_a_running_total(spark, most):
    rows = [(i, i % 7 if i % 5 else None, f"t{i}") for i in range(40)]
    want, total = [], 0
    for i, n, x in rows:
        total += n or 0
        if total > most:
            break
        want.append((i, n, x))
    df = spark.createDataFrame(rows, "i long, n long, x string").repartition(5)
    assert sorted(map(tuple, budgets.prefix_cut(df, "i", "n", most).collect())) == want
    assert budgets.prefix_cut(df.where("false"), "i", "n", most).count() == 0


def test_a_stream_of_events_notifies_like_the_whole_log(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", "c", None]), 1_000_000 + 50 * i // 3 + r.randrange(40)) for i in range(400)]
    rows += [("steady", 1_000_000 + 50 * i) for i in range(120)]
    rows.sort(key=lambda x: x[1] + r.randrange(100))  # late by less than the watermark
    for i in range(8):
        part = spark.createDataFrame(rows[i * 65 : (i + 1) * 65], "repo string, s long").withColumn("at", F.timestamp_seconds("s"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # What comes long after moves the watermark past all else.
    spark.createDataFrame([("end", 9_000_000)], "repo string, s long").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("repo string, s long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = queue.rate_limited_stream(stream, "repo", "at", 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = set(tuples(queue.rate_limited(spark.createDataFrame(rows, "repo string, s long"), "repo", "s", 60)))
    assert set(tuples(spark.table("limited"), "repo", "at")) == want
    # An event every 50 seconds is a notice every 100, where a session would be one for ever.
    assert sum(k == "steady" for k, _ in want) == 60


def test_rate_limits_of_keys_that_fill_many_ranges(spark):
    rows = [("hot", i) for i in range(5000)] + [("hot2", 3 * i) for i in range(2000)]
    got = tuples(queue.rate_limited(spark.createDataFrame(rows, "repo string, s long").repartition(7), "repo", "s", 10))
    assert got == sorted([("hot", i) for i in range(0, 5000, 10)] + [("hot2", i) for i in range(0, 6000, 12)], key=repr)

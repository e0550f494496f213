"""Every operator on the generated tables, with SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names, paths, text
from factloom.operators import aggregates, budgets, graph, joins, rules
from factloom.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


long = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


# Absence and presence


@query("""SELECT c_custkey, c_name AS dependency, 'unused' AS kind, 'medium' AS severity, c_mktsegment AS project
FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def unused_declared(spark, sf):
    """Declared customers that no pending order refers to."""
    used = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    rows = t(spark, sf, "customer").join(used, "c_custkey", "left_anti").withColumn("kind", F.lit("unused"))
    return rows.select("c_custkey", F.col("c_name").alias("dependency"), "kind", rules.severity(F.col("kind"), F.lit("high")).alias("severity"), F.col("c_mktsegment").alias("project"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def used_semi(spark, sf):
    used = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(used, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id, lang, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unreferenced_documents(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", "source").join(t(spark, sf, "labels"), "doc_id", "left_anti")


@query("""SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING bool_and(l_returnflag IN ('A', 'N')) AND count(*) >= 2""")
def should_be_dev_all_quantifier(spark, sf):
    """Used, and only ever from code that is not shipped."""
    by = t(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_and(F.col("l_returnflag").isin("A", "N")).alias("all_dev"), F.count("*").alias("n"))
    return by.where("all_dev and n >= 2").select("l_suppkey", "l_partkey", "n")


@query("""SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, count(*) AS n, min(event_type) AS event_type
FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1 AND count(*) >= 2""")
def type_only_all(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")
    by = t(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"), F.max("event_type").alias("m"))
    return by.where("event_type = m and n >= 2").drop("m")


@query("""SELECT o_custkey, count(*) AS removed, max(o_orderkey) AS last_removed FROM orders WHERE o_orderstatus = 'F'
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""")
def removed_last_usage(spark, sf):
    orders = t(spark, sf, "orders")
    gone = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("removed"), F.max("o_orderkey").alias("last_removed"))
    return gone.join(orders.where("o_orderstatus = 'O'"), "o_custkey", "left_anti")


# Rules, severities, groups


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' END AS rule
FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000 OR o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def first_match_rule(spark, sf):
    ordered = [("pending", F.col("o_orderstatus") == "P"), ("large", F.col("o_totalprice") > 300000), ("urgent", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))]
    return rules.first_match(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), ordered).select("o_orderkey", "rule")


SEVERITY_SQL = """SELECT o_orderkey, kind, least(confidence, cap) AS c, ['critical', 'high', 'medium', 'low', 'info'][least(ceiling + 3 - confidence, 5)] AS severity FROM (
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'unused' WHEN '2-HIGH' THEN 'type-only' WHEN '3-MEDIUM' THEN 'footprint' ELSE 'info' END AS kind,
CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 4 ELSE 5 END AS ceiling,
CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS confidence, CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 3 END AS cap FROM orders)"""


def _severities(spark, sf):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = F.when(priority == "1-URGENT", "unused").when(priority == "2-HIGH", "type-only").when(priority == "3-MEDIUM", "footprint").otherwise("info")
    computed = F.when(status == "F", "high").when(status == "O", "medium").otherwise("low")
    rows = t(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), computed.alias("computed"))
    shown = rules.capped_confidence(F.col("computed"), F.when(F.col("kind") == "unused", "medium").otherwise("high"))
    return rows.select("o_orderkey", "kind", shown.alias("confidence"), rules.severity(F.col("kind"), F.col("computed")).alias("severity"))


@query(f"SELECT o_orderkey, kind, ['low', 'medium', 'high'][c] AS confidence, severity FROM ({SEVERITY_SQL})")
def severity_ladder(spark, sf):
    """Severity from the computed confidence, which is capped only afterwards."""
    return _severities(spark, sf)


@query(f"SELECT kind, severity, count(*) AS n FROM ({SEVERITY_SQL}) WHERE severity IN ('critical', 'high', 'medium', 'low') GROUP BY 1, 2")
def fail_on_threshold(spark, sf):
    return _severities(spark, sf).where(rules.at_or_above(F.col("severity"), "low")).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_type <> 'view' THEN 'verdict' WHEN value > 30 THEN 'fact' WHEN value > 10 THEN 'awareness' WHEN user_id % 2 = 0 THEN 'note' ELSE 'incomplete' END AS finding_group,
count(*) AS n FROM events GROUP BY 1""")
def finding_groups(spark, sf):
    kind = F.when(F.col("event_type") == "view", "info").otherwise("unused")
    group = rules.finding_group(kind, F.col("value") > 30, F.col("value") > 10, F.when(F.col("user_id") % 2 == 0, True))
    return t(spark, sf, "events").groupBy(group.alias("finding_group")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def finding_summary(spark, sf):
    return aggregates.finding_summary(t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"]).withColumn("gid", long("gid"))


# Surfaces and graphs


@query("""WITH direct AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey AS name FROM supplier),
reach AS (SELECT DISTINCT s_nationkey AS nation, l_partkey AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
rest AS (SELECT nation, name FROM reach EXCEPT SELECT nation, name FROM direct)
SELECT d.nation, d.direct, coalesce(r.transitive, 0) AS transitive FROM (SELECT nation, count(*) AS direct FROM direct GROUP BY 1) d LEFT JOIN (SELECT nation, count(*) AS transitive FROM rest GROUP BY 1) r ON r.nation = d.nation""")
def surface_totals(spark, sf):
    """Direct names of a nation, and what they reach without those names."""
    supplier = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    direct = supplier.select("nation", F.col("s_suppkey").alias("name")).distinct()
    reach = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("name")).join(supplier, "s_suppkey").select("nation", "name").distinct()
    rest = reach.join(direct, ["nation", "name"], "left_anti").groupBy("nation").agg(F.count("*").alias("transitive"))
    return direct.groupBy("nation").agg(F.count("*").alias("direct")).join(rest, "nation", "left").select("nation", "direct", F.coalesce("transitive", F.lit(0)).cast("bigint").alias("transitive"))


@query("""SELECT n_regionkey AS region, CASE WHEN count(s.k) = 0 THEN 'none' WHEN count(s.k) < count(*) OR count_if(s.open) > 0 THEN 'partial' ELSE 'complete' END AS completeness
FROM nation LEFT JOIN (SELECT s_nationkey AS k, min(s_acctbal) < 0 AS open FROM supplier GROUP BY 1) s ON s.k = n_nationkey GROUP BY 1""")
def graph_completeness(spark, sf):
    projects = t(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("k"))
    graphs = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.min("s_acctbal") < 0).alias("incomplete"))
    return aggregates.graph_completeness(projects, graphs, ["k"], "region")


DIFF_SQL = """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS before, b.v AS after
FROM (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k
WHERE a.v IS DISTINCT FROM b.v"""


@query(DIFF_SQL)
def snapshot_diff(spark, sf):
    state = lambda s: t(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return joins.snapshot_diff(state("F"), state("P"), ["k"], "v")


@query("""WITH d AS (SELECT coalesce(a.s, b.s) AS s, coalesce(a.p, b.p) AS p, CASE WHEN a.s IS NULL THEN 'added' ELSE 'removed' END AS change FROM
(SELECT DISTINCT o_custkey AS s, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS s, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P') b ON a.s = b.s AND a.p = b.p WHERE a.s IS NULL OR b.s IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY s, change ORDER BY p) AS n FROM d)
SELECT x.s, x.p AS from_kind, y.p AS to_kind FROM r x JOIN r y ON x.s = y.s AND x.n = y.n AND x.change = 'removed' AND y.change = 'added'""")
def moved_pairs(spark, sf):
    state = lambda s: t(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("p"), F.lit(1).alias("v")).distinct()
    return joins.moved_pairs(joins.snapshot_diff(state("F"), state("P"), ["s", "p"], "v"), "s", "p")


@query("""WITH RECURSIVE c(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION ALL SELECT src, dst // 2 FROM c WHERE dst > 0)
SELECT src, count(*) AS reach, min(dst) AS root FROM c GROUP BY 1""")
def closure_tree(spark, sf):
    edges = t(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return graph.closure(edges).groupBy("src").agg(F.count("*").alias("reach"), F.min("dst").alias("root"))


CYCLE_SQL = "SELECT p_partkey AS src, p_partkey - p_partkey % 50 + (7 * (p_partkey % 50) + 3) % 50 AS dst FROM part"


def _cycles(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.expr("p_partkey - p_partkey % 50 + (7 * (p_partkey % 50) + 3) % 50").alias("dst"))


REACH_SQL = f"""WITH RECURSIVE e AS ({CYCLE_SQL}), c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst), reach AS (SELECT src, dst FROM c WHERE src <> dst) """


@query(REACH_SQL + "SELECT src, dst FROM reach")
def closure_cyclic(spark, sf):
    return graph.closure(_cycles(spark, sf))


@query(REACH_SQL + """, d AS (SELECT src, dst FROM reach WHERE src % 3 = 0), one AS (SELECT dst FROM d GROUP BY 1 HAVING count(*) = 1 AND dst NOT IN (SELECT src FROM d))
SELECT d.src, count(*) AS transitive, count(one.dst) AS exclusive FROM d LEFT JOIN one ON one.dst = d.dst GROUP BY 1""")
def reach_exclusive(spark, sf):
    """What a direct dependency reaches, and what of it nothing else reaches."""
    edges = _cycles(spark, sf)
    return graph.exclusive_reach(graph.closure(edges, starts=edges.where("src % 3 = 0")))


@query(f"WITH RECURSIVE e AS ({CYCLE_SQL}), c(src, dst) AS (SELECT dst, src FROM e WHERE dst % 5 = 0 UNION SELECT c.src, e.src FROM c JOIN e ON e.dst = c.dst) SELECT src AS gate, count(*) AS opened FROM c WHERE src <> dst GROUP BY 1")
def reverse_gate_closure(spark, sf):
    edges = _cycles(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(edges, starts=edges.where("src % 5 = 0")).groupBy(F.col("src").alias("gate")).agg(F.count("*").alias("opened"))


@query(REACH_SQL + ", d AS (SELECT src, dst FROM reach WHERE src % 3 = 0) SELECT dst AS name, min(src) AS required_by FROM d WHERE dst % 3 = 0 GROUP BY 1")
def peer_required_by(spark, sf):
    edges = _cycles(spark, sf)
    reach = graph.closure(edges, starts=edges.where("src % 3 = 0"))
    return graph.reached_by(reach, edges.where("src % 3 = 0").select(F.col("src").alias("dst"))).withColumnRenamed("dst", "name")


@query("""SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS members, min(l_orderkey) AS first_member, bool_and(l_returnflag = 'R') AS dev, bool_or(l_linenumber = 1) AS direct
FROM lineitem GROUP BY 1, 2 ORDER BY direct DESC, l_partkey, l_suppkey LIMIT 5000""")
def unified_graph(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", (F.col("l_returnflag") == "R").alias("d"), (F.col("l_linenumber") == 1).alias("first"))
    return aggregates.unified_graph(rows, ["l_partkey", "l_suppkey"], "l_orderkey", "d", "first", 5000)


@query("""SELECT l_suppkey, CAST(sum(b) AS DOUBLE) AS bytes, count(b) AS sized, count(*) AS total FROM (SELECT l_suppkey, l_partkey, CASE WHEN count(*) = count(s) THEN min(s) END AS b
FROM (SELECT l_suppkey, l_partkey, CASE WHEN l_quantity > 2 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END AS s FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def footprint_lower_bound(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_quantity") > 2, F.col("l_extendedprice")).alias("size"))
    return aggregates.footprint(rows, "l_suppkey", "l_partkey", "size").withColumn("bytes", F.col("bytes").cast("double"))


# Ancestors, prefixes, ranges

URL_PATH = r"^https?://([^?#]*?)/?(?:[?#].*)?$"


def _page_paths(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_extract("url", URL_PATH, 1).alias("path"))


PATH_SQL = r"SELECT page_id, regexp_extract(url, '^https?://([^?#]*?)/?(?:[?#].*)?$', 1) AS path FROM pages"


@query(f"""WITH p AS ({PATH_SQL}), roots AS (SELECT DISTINCT path FROM p UNION SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM p WHERE page_id % 3 = 0)
SELECT page_id, max_by(r.path, len(r.path)) AS parent FROM (SELECT page_id, path, unnest([array_to_string(string_split(path, '/')[1:i], '/') for i in range(1, len(string_split(path, '/')))]) AS a FROM p) x JOIN roots r ON r.path = x.a GROUP BY 1""")
def project_tree_parent(spark, sf):
    """The deepest project strictly above each one."""
    p = _page_paths(spark, sf)
    roots = p.select("path").union(p.where("page_id % 3 = 0").select(paths.directory(F.col("path")))).distinct().withColumnRenamed("path", "parent")
    return joins.nearest_ancestor(p, roots, "path", "parent", strict=True).where("parent is not null").select("page_id", "parent")


@query(f"""WITH p AS ({PATH_SQL}), roots AS (SELECT DISTINCT string_split(path, '/')[1] AS root, 1 AS d FROM p UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/'), 2 FROM p WHERE page_id % 2 = 0 AND contains(path, '/'))
SELECT p.page_id, arg_max(root, d) AS owner FROM p JOIN roots ON p.path = root OR starts_with(p.path, root || '/') GROUP BY 1""")
def nearest_ancestor(spark, sf):
    p = _page_paths(spark, sf)
    parts = F.split("path", "/")
    roots = p.select(parts[0].alias("owner")).union(p.where("page_id % 2 = 0 and contains(path, '/')").select(F.array_join(F.slice(parts, 1, 2), "/"))).distinct()
    return joins.nearest_ancestor(p, roots, "path", "owner").select("page_id", "owner")


@query(f"""WITH p AS ({PATH_SQL}), m AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS module FROM p WHERE page_id % 4 = 0 UNION SELECT DISTINCT string_split(path, '/')[1] FROM p WHERE page_id % 3 = 0)
SELECT page_id, max_by(module, len(module)) AS module FROM p LEFT JOIN m ON p.path = module OR starts_with(p.path, module || '/') GROUP BY 1""")
def longest_prefix_owner(spark, sf):
    p = _page_paths(spark, sf)
    parts = F.split("path", "/")
    modules = p.where("page_id % 4 = 0").select(F.array_join(F.slice(parts, 1, 2), "/").alias("module")).union(p.where("page_id % 3 = 0").select(parts[0]))
    return joins.longest_prefix(p, modules, "path", "module").select("page_id", "module")


@query("""SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = orders.o_custkey AND x.o_orderstatus = 'P'
AND date_diff('day', DATE '1970-01-01', CAST(x.o_orderdate AS DATE)) BETWEEN date_diff('day', DATE '1970-01-01', CAST(orders.o_orderdate AS DATE)) AND date_diff('day', DATE '1970-01-01', CAST(orders.o_orderdate AS DATE)) + 90)""")
def range_removed_lines(spark, sf):
    """References whose span of lines holds a removed line, as spans of days."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("low"))
    spans = orders.where("o_orderstatus = 'F'").withColumn("high", F.col("low") + 90)
    return joins.range_overlap(spans, orders.where("o_orderstatus = 'P'"), ["o_custkey"], "low", "high", "low", 64).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, u.supplier FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) u ON u.l_orderkey = o_orderkey""")
def unique_match_resolve(spark, sf):
    candidates = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("supplier"))
    return joins.unique_match(t(spark, sf, "orders").select("o_orderkey"), candidates, "o_orderkey", "supplier")


@query("""SELECT doc_id, 'document' AS side FROM (SELECT doc_id FROM documents WHERE lang <> 'en' EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang <> 'en')""")
def symmetric_mismatch(spark, sf):
    return joins.symmetric_mismatch(t(spark, sf, "documents").where("lang <> 'en'"), t(spark, sf, "labels"), "doc_id", "document", "label")


# Capabilities


def _parts(spark, sf):
    return t(spark, sf, "part").select(F.concat_ws(":", "p_type", "p_size").alias("cluster"), F.col("p_brand").alias("side"), F.col("p_name").alias("name"), "p_partkey")


PART_SQL = "SELECT p_type || ':' || p_size AS cluster, p_brand AS side, p_name AS name, p_partkey FROM part"


@query(f"WITH d AS (SELECT DISTINCT cluster, side, name FROM ({PART_SQL})) SELECT * FROM d WHERE cluster IN (SELECT cluster FROM d GROUP BY 1 HAVING count(DISTINCT side) >= 2)")
def capability_overlap(spark, sf):
    return aggregates.overlaps(_parts(spark, sf), "cluster", "side", "name")


@query(f"WITH d AS (SELECT DISTINCT cluster, side, name FROM ({PART_SQL})) SELECT * FROM d WHERE (cluster, side) IN (SELECT (cluster, side) FROM d GROUP BY cluster, side HAVING count(DISTINCT name) >= 2)")
def capability_duplicates(spark, sf):
    return aggregates.overlaps(_parts(spark, sf), "cluster", "side", "name", across=False)


@query(f"""WITH d AS (SELECT DISTINCT cluster, side, name FROM ({PART_SQL})), o AS (SELECT * FROM d WHERE cluster IN (SELECT cluster FROM d GROUP BY 1 HAVING count(DISTINCT side) >= 2))
SELECT o.* FROM o WHERE EXISTS (SELECT 1 FROM ({PART_SQL}) a WHERE a.p_partkey % 10 = 0 AND a.cluster = o.cluster AND a.side = o.side AND a.name = o.name)""")
def pr_added_only(spark, sf):
    """Overlaps of what a change adds."""
    rows = _parts(spark, sf)
    added = rows.where("p_partkey % 10 = 0").select("cluster", "side", "name")
    return aggregates.overlaps(rows, "cluster", "side", "name").join(added, ["cluster", "side", "name"], "left_semi")


# Caps and budgets


@query("""WITH d AS (SELECT DISTINCT c_mktsegment AS project, c_name AS statement FROM customer WHERE c_acctbal < 0), r AS (SELECT *, row_number() OVER (ORDER BY project, statement) AS n FROM d)
SELECT project, statement FROM r WHERE n <= 100 UNION ALL SELECT NULL, (count(*) - 100) || ' more' FROM r HAVING count(*) > 100""")
def cap_with_remainder(spark, sf):
    notes = t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_mktsegment").alias("project"), F.col("c_name").alias("statement"))
    return aggregates.capped(notes, ["project", "statement"], 100, "statement")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS run, sum(n_chars) OVER () AS whole FROM documents) WHERE run <= whole // 2")
def scan_truncate_prefix(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "n_chars")
    whole = docs.agg(F.sum("n_chars")).first()[0] or 0
    return budgets.prefix_cut(docs, "doc_id", "n_chars", whole // 2)


@query("""WITH RECURSIVE d AS (SELECT source || ':' || (doc_id // 640) AS project, n_chars AS s, row_number() OVER (PARTITION BY source, doc_id // 640 ORDER BY doc_id) AS i FROM documents),
f AS (SELECT project, 0 AS i, 0 AS taken, 0::BIGINT AS spent FROM (SELECT DISTINCT project FROM d) UNION ALL
SELECT f.project, d.i, f.taken + CASE WHEN f.spent + d.s <= 20000 THEN 1 ELSE 0 END, f.spent + CASE WHEN f.spent + d.s <= 20000 THEN d.s ELSE 0 END FROM f JOIN d ON d.project = f.project AND d.i = f.i + 1)
SELECT project, CAST(arg_max(taken, i) AS BIGINT) AS taken, arg_max(spent, i) AS spent FROM f GROUP BY 1""")
def impact_budget_greedy(spark, sf):
    docs = t(spark, sf, "documents").select(F.concat_ws(":", "source", F.expr("doc_id div 640")).alias("project"), "doc_id", "n_chars")
    return budgets.greedy_fit(docs, "project", "doc_id", "n_chars", 20000)


@query("""SELECT n.n_nationkey AS nation, CAST(0.7 + CASE WHEN coalesce(s.n, 0) > 0 THEN 0.1 ELSE 0 END + CASE WHEN n.n_regionkey < 3 THEN 0.1 ELSE 0 END + CASE WHEN coalesce(c.n, 0) >= 5 THEN 0.1 ELSE 0 END - CASE WHEN coalesce(s.low, 0) < 0 THEN 0.1 ELSE 0 END AS DOUBLE) AS score
FROM nation n LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n, min(s_acctbal) AS low FROM supplier GROUP BY 1) s ON s.k = n.n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n.n_nationkey""")
def detection_score(spark, sf):
    s = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s"), F.min("s_acctbal").alias("low"))
    c = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    rows = t(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey").join(s, "nation", "left").join(c, "nation", "left")
    score = aggregates.detection_score(F.coalesce("s", F.lit(0)) > 0, F.col("n_regionkey") < 3, F.coalesce("c", F.lit(0)), F.coalesce("low", F.lit(0.0)) < 0)
    return rows.select("nation", score.cast("double").alias("score"))


# Names, paths, text


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN ('red widget', 'small ring') OR starts_with(p_name, 'blue ')")
def allowlist_prefix(spark, sf):
    return joins.prefix_listed(t(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_name"), ["red widget", "small ring"], ["blue "])


@query(r"SELECT page_id, regexp_matches(path, '(^|/)(test|tests|__tests__|__mocks__|spec|specs|e2e|cypress|playwright|fixtures|benchmark|benchmarks|bench|scripts|\.storybook|stories)/') OR regexp_matches(path, '(^|/)test_[^/]+\.py$') AS non_shipped FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'tests/' || page_id || '.ts' WHEN 1 THEN 'src/test_' || page_id || '.py' WHEN 2 THEN 'src/' || page_id || '/test' WHEN 3 THEN 'a/scripts/x' ELSE 'src/a.ts' END AS path FROM pages)")
def nonshipped_path(spark, sf):
    n, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(n == 0, F.concat(F.lit("tests/"), i, F.lit(".ts"))).when(n == 1, F.concat(F.lit("src/test_"), i, F.lit(".py"))).when(n == 2, F.concat(F.lit("src/"), i, F.lit("/test"))).when(n == 3, F.lit("a/scripts/x")).otherwise(F.lit("src/a.ts"))
    return t(spark, sf, "pages").select("page_id", paths.is_non_shipped(path).alias("non_shipped"))


SPEC_SQL = "CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN '^1.' || page_id WHEN 2 THEN 'workspace:*' WHEN 3 THEN './pkg/' || page_id WHEN 4 THEN 'owner/repo' || page_id WHEN 5 THEN 'git+' || url WHEN 6 THEN 'link:../x' ELSE 'npm:other@1' END"


@query(f"""SELECT page_id, CASE WHEN starts_with(s, 'workspace:') THEN 'workspace' WHEN starts_with(s, 'link:') THEN 'link' WHEN starts_with(s, './') THEN 'file' WHEN starts_with(s, 'git+') OR regexp_matches(s, '^\\w+/\\w+$') THEN 'git' ELSE 'registry' END AS specifier FROM (SELECT page_id, {SPEC_SQL} AS s FROM pages)""")
def specifier_class(spark, sf):
    i = F.col("page_id").cast("string")
    options = [F.col("url"), F.concat(F.lit("^1."), i), F.lit("workspace:*"), F.concat(F.lit("./pkg/"), i), F.concat(F.lit("owner/repo"), i), F.concat(F.lit("git+"), F.col("url")), F.lit("link:../x"), F.lit("npm:other@1")]
    return t(spark, sf, "pages").select("page_id", names.specifier_type(F.element_at(F.array(*options), (F.col("page_id") % 8 + 1).cast("int"))).alias("specifier"))


@query("SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin FROM pages")
def registry_origin(spark, sf):
    return t(spark, sf, "pages").select("page_id", names.registry_origin(F.col("url")).alias("origin"))


@query("SELECT p_partkey, lower(regexp_replace(p_brand || '_' || p_type || '.X', '[-_.]+', '-', 'g')) AS name FROM part")
def pep503_name(spark, sf):
    return t(spark, sf, "part").select("p_partkey", names.python_name(F.concat("p_brand", F.lit("_"), "p_type", F.lit(".X"))).alias("name"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS scripts, len(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)[1]) AS first_chars FROM pages")
def script_blocks(spark, sf):
    found = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return t(spark, sf, "pages").select("page_id", F.size(found).cast("bigint").alias("scripts"), F.length(F.try_element_at(found, F.lit(1))).cast("bigint").alias("first_chars"))


@query("SELECT doc_id, len(text) - len(replace(text, chr(10), '')) + 1 AS lines, CASE WHEN contains(text, 'the') THEN len(split_part(text, 'the', 1)) - len(replace(split_part(text, 'the', 1), chr(10), '')) + 1 END AS line FROM documents")
def line_extract(spark, sf):
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return t(spark, sf, "documents").select("doc_id", (breaks + 1).cast("bigint").alias("lines"), text.line_of(F.col("text"), F.lit("the")).cast("bigint").alias("line"))


@query("""SELECT p_name, arg_min(w, d * 100 + o) AS suggestion FROM (SELECT p_name, w, o, levenshtein(p_name, w) AS d FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (VALUES ('blue bold', 1), ('red rings', 2), ('small gear', 3), ('green nut', 4)) v(w, o)) WHERE d <= 2 GROUP BY 1""")
def edit_distance(spark, sf):
    words = ["blue bold", "red rings", "small gear", "green nut"]
    scored = F.array_sort(F.filter(F.array(*[F.struct(F.levenshtein("p_name", F.lit(w)).alias("d"), F.lit(i).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: x["d"] <= 2))
    return t(spark, sf, "part").select("p_name").distinct().select("p_name", F.try_element_at(scored, F.lit(1))["w"].alias("suggestion")).where("suggestion is not null")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT user_id, sha256(string_agg(event_type, chr(10) ORDER BY event_type)) AS digest FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def content_hash(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(text.set_hash(F.collect_set("event_type")).alias("digest"))


# Notes and evidence


@query("SELECT event_type, count(*) AS usages, bool_and(value > 0.5) AS complete FROM events GROUP BY 1")
def usage_attribution(spark, sf):
    return aggregates.usage_attribution(t(spark, sf, "events").select("event_type", (F.col("value") > 0.5).alias("ok")), "event_type", "ok")


@query("""SELECT a.event_type, a.total, b.examples FROM (SELECT event_type, count(*) AS total FROM events GROUP BY 1) a JOIN (SELECT event_type, string_agg(u, ',' ORDER BY u) AS examples FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS u,
row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM (SELECT DISTINCT event_type, user_id FROM events)) WHERE r <= 5 GROUP BY 1) b ON a.event_type = b.event_type""")
def evidence_top5(spark, sf):
    return aggregates.first_values(t(spark, sf, "events").select("event_type", "user_id"), ["event_type"], "user_id", 5, "examples")


# The job queue


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def queue_dedupe(spark, sf):
    return queue.deduplicated(t(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = event_type""")
def queue_supersede(spark, sf):
    jobs = t(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("head"), F.col("event_type").alias("before"))
    return queue.superseded(jobs, ["user_id"], ["event_id"], "head", "before").select("event_id", "user_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events), r AS (SELECT user_id, min(seconds) AS seconds FROM e GROUP BY 1 UNION ALL
SELECT r.user_id, min(e.seconds) FROM r JOIN e ON e.user_id = r.user_id AND e.seconds >= r.seconds + 86400 GROUP BY r.user_id, r.seconds) SELECT user_id, seconds FROM r""")
def busy_limit(spark, sf):
    """At most one notice a day for each user."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return queue.rate_limited(t(spark, sf, "events").select("user_id", seconds.alias("seconds")), "user_id", "seconds", 86400)


@query("""SELECT user_id, event_type, last_used, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, event_type) AS place FROM (SELECT user_id, event_type, max(event_id) AS last_used FROM events GROUP BY 1, 2)) WHERE place <= 4""")
def lru_cache(spark, sf):
    return aggregates.keep_latest(t(spark, sf, "events"), "user_id", "event_type", "event_id", 4).withColumn("place", long("place"))




# Listings, changes, health, reports


@query("""SELECT reason, count(*) AS total FROM (SELECT CASE WHEN source = 'src1' THEN 'symlink' WHEN doc_id % 7 = 0 THEN 'excluded-directory' WHEN doc_id % 5 = 0 THEN 'generated-file' WHEN n_chars > 5000 AND doc_id % 3 <> 0 THEN 'file-too-large' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1""")
def scan_skip_reasons(spark, sf):
    """Documents as entries of a repository: why each is not read."""
    from factloom.sources.files import Limits, skip_reason

    n = F.col("doc_id")
    name = F.when(n % 5 == 0, "a.min.js").when(n % 3 == 0, "yarn.lock").otherwise("a.py")
    path = F.concat(F.lit("p"), n.cast("string"), F.when(n % 7 == 0, "/node_modules/").otherwise("/"), name)
    entries = t(spark, sf, "documents").select(path.alias("path"), F.col("n_chars").alias("size"), F.when(F.col("source") == "src1", "symlink").otherwise("file").alias("kind"))
    return entries.withColumn("reason", skip_reason(Limits(file_bytes=5000))).where("reason is not null").groupBy("reason").agg(F.count("*").alias("total"))


@query(f"""WITH p AS ({PATH_SQL}), r AS (SELECT DISTINCT string_split(path, '/')[1] AS root FROM p WHERE page_id % 10 = 0 UNION SELECT 'nowhere') SELECT root, count(path) > 0 AS matched, count(path) AS files FROM r LEFT JOIN p ON starts_with(path, root || '/') GROUP BY 1""")
def scope_counts(spark, sf):
    from factloom.sources import files

    p = _page_paths(spark, sf)
    roots = p.where("page_id % 10 = 0").select(F.split("path", "/")[0].alias("root")).union(spark.range(1).select(F.lit("nowhere"))).distinct()
    return files.scope_counts(p, roots).select("root", "matched", long("files").alias("files"))


@query("""WITH b AS (SELECT o_custkey AS name, o_orderpriority AS kind, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), h AS (SELECT o_custkey AS name, o_orderpriority AS kind, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2),
d AS (SELECT coalesce(b.name, h.name) AS name, coalesce(b.kind, h.kind) AS kind, CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN h ON b.name = h.name AND b.kind = h.kind WHERE b.v IS DISTINCT FROM h.v),
r AS (SELECT *, row_number() OVER (PARTITION BY name, change ORDER BY kind) AS n, count(*) FILTER (WHERE change = 'added') OVER (PARTITION BY name) AS a, count(*) FILTER (WHERE change = 'removed') OVER (PARTITION BY name) AS g FROM d)
SELECT CASE WHEN change = 'removed' AND n <= a THEN 'changed' ELSE change END AS change, CASE WHEN change = 'removed' AND n <= a THEN true ELSE false END AS moved, count(*) AS n FROM r WHERE NOT (change = 'added' AND n <= g) GROUP BY 1, 2""")
def dependency_changes(spark, sf):
    """Orders as declarations of a customer under a priority, from one status to another."""
    from factloom.operators import changes

    state = lambda s: t(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.lit("e").alias("ecosystem"), F.lit(".").alias("project"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("kind")).agg(F.max("o_orderkey").alias("constraint"))
    found = changes.dependency_changes(state("F"), state("O"))
    moved = F.coalesce(F.col("kind_before") != F.col("kind_after"), F.lit(False))
    return found.groupBy("change", moved.alias("moved")).agg(F.count("*").alias("n"))


@query("""WITH one AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem WHERE l_quantity > 40 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
SELECT p_partkey, signal FROM (SELECT p_partkey, unnest([CASE WHEN s_acctbal < 0 THEN 'registry-deprecated' END, CASE WHEN s_nationkey < 5 THEN 'repository-archived' END, 'locked-version-published']) AS signal FROM part JOIN one ON l_partkey = p_partkey JOIN supplier ON s_suppkey = s) WHERE signal IS NOT NULL""")
def health_facts(spark, sf):
    """Parts with exactly one supplier of large quantities, and what is known of it."""
    from factloom.operators import health

    fixed = {"ecosystem": F.lit("e"), "project": F.lit(".")}
    parts = t(spark, sf, "part").withColumns(fixed).withColumn("name", F.col("p_partkey").cast("string"))
    nodes = t(spark, sf, "lineitem").where("l_quantity > 40").withColumns(fixed).select("ecosystem", "project", F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("version"), F.lit("o").alias("origin"))
    locked = health.locked_version(parts, nodes)
    supplier = t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("version"), (F.col("s_acctbal") < 0).alias("deprecated"), (F.col("s_nationkey") < 5).alias("archived"))
    registry = locked.select("ecosystem", "name", "version").distinct().join(supplier, "version").withColumn("published", F.lit("2024-01-31"))
    return health.facts(locked, registry).select(F.col("name").cast("bigint").alias("p_partkey"), "signal")


@query("""SELECT c_custkey, '{"balance":' || CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) || ',"name":"' || c_name || '"' || CASE WHEN c_nationkey > 10 THEN ',"nation":' || c_nationkey ELSE '' END || '}' AS report FROM customer""")
def canonical_json(spark, sf):
    from factloom.operators import report

    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")).alias("nation"), F.round("c_acctbal").cast("bigint").alias("balance"))
    return rows.select("c_custkey", report.canonical_json(["name", "nation", "balance"]).alias("report"))


@query(f"""WITH s AS ({SEVERITY_SQL}) SELECT 'neutral' AS conclusion, count_if(kind <> 'info') AS verdicts, count_if(kind <> 'info' AND severity IN ('critical', 'high', 'medium')) AS failing, 'medium' AS worst FROM s""")
def check_outcome(spark, sf):
    from factloom.operators import report

    no = F.lit(None).cast("boolean")
    rows = _severities(spark, sf).withColumn("finding_group", rules.finding_group(F.col("kind"), no, no, no))
    return report.outcome(rows, "medium")

"""Queries of graphs, diffs and Markdown (G, SRC12-20, EXT9-11 and AGG7 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import graph as G
from larkspur.plans.model import relations, symbols, with_
from larkspur.plans.registry import Registry
from larkspur.session import table
from larkspur.sources import diff as D
from larkspur.sources import markdown as M

R = Registry()
_c = F.col

EDGES = """edges AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'r0', 'x' UNION SELECT 'x', 'r0')"""


def edges(spark, d):
    """The star schema's references as a graph, with one cycle."""
    t = lambda n: table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), _c(c))
    out = t("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).union(t("supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey"))).union(t("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(t("orders").where("o_orderstatus = 'F'").select(name("o", "o_orderkey"), name("c", "o_custkey")))
    return out.union(spark.createDataFrame([("r0", "x"), ("x", "r0")], "src string, dst string")).distinct()


@R.add("G1", f"""WITH RECURSIVE {EDGES}, cut AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS b FROM edges) WHERE b <= 20),
walk AS (SELECT 's' || s_suppkey AS seed, ['s' || s_suppkey] AS path, NULL::VARCHAR AS status FROM supplier UNION ALL
SELECT w.seed, CASE WHEN c.dst IS NULL THEN w.path ELSE list_append(w.path, c.dst) END, CASE WHEN c.dst IS NULL THEN 'leaf' WHEN list_contains(w.path, c.dst) THEN 'cycle' WHEN len(w.path) = 11 THEN 'max-depth' END FROM walk w LEFT JOIN cut c ON c.src = w.path[-1] WHERE w.status IS NULL)
SELECT seed, array_to_string(path, '>') AS path, status FROM walk WHERE status IS NOT NULL""")
def g1(spark, d):
    """All chains from each supplier, with leaf, cycle and depth ends."""
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return G.paths(edges(spark, d), seeds, 10, 20).select("seed", F.array_join("path", ">").alias("path"), "status")


R.add("Q13", R.sql["G1"].replace("FROM supplier", "FROM supplier WHERE s_suppkey <= 5"))(lambda spark, d: G.paths(edges(spark, d), table(spark, d, "supplier").where("s_suppkey <= 5").select(F.concat(F.lit("s"), "s_suppkey").alias("node")), 10, 20).select("seed", F.array_join("path", ">").alias("path"), "status"))
R.sql["Q13"] = R.sql["G1"].replace("FROM supplier UNION ALL", "FROM supplier WHERE s_suppkey <= 5 UNION ALL")


@R.add("G11", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT 'n' || n_nationkey AS seed, ['n' || n_nationkey] AS path, NULL::VARCHAR AS status FROM nation UNION ALL
SELECT w.seed, CASE WHEN c.dst IS NULL THEN w.path ELSE list_append(w.path, c.dst) END, CASE WHEN c.dst IS NULL THEN 'leaf' WHEN list_contains(w.path, c.dst) THEN 'cycle' WHEN len(w.path) = 4 THEN 'max-depth' END FROM walk w LEFT JOIN edges c ON c.src = w.path[-1] WHERE w.status IS NULL)
SELECT seed, status, count(*) AS chains FROM walk WHERE status IS NOT NULL GROUP BY ALL""")
def g11(spark, d):
    """Owner chains of every seed at once, counted by how they end."""
    seeds = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return G.paths(edges(spark, d), seeds, 3, 20).groupBy("seed", "status").agg(F.count("*").alias("chains"))


_ALIAS = "SELECT 'p' || p_partkey AS a, 'p' || (p_partkey - p_partkey % 8 + p_partkey * 5 % 8) AS b FROM part UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey - p_partkey % 4) FROM part"


@R.add("G2", f"""WITH RECURSIVE pairs AS ({_ALIAS}), both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs),
r AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM r JOIN both_ways e ON r.b = e.a) SELECT a AS name, min(b) AS component FROM r GROUP BY a""")
def g2(spark, d):
    k = _c("p_partkey")
    other = F.explode(F.array(k - k % 8 + k * 5 % 8, k - k % 4))
    return G.alias_components(table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("a"), other.alias("o")).select("a", F.concat(F.lit("p"), "o").alias("b")))


_LEVELS = f"WITH RECURSIVE {EDGES}, walk AS (SELECT 's' || s_suppkey AS node, 0 AS level FROM supplier WHERE s_suppkey <= 10 UNION SELECT e.dst, w.level + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.level < 5), levels AS (SELECT node, min(level) AS level FROM walk GROUP BY node)"


def _levels(spark, d):
    return G.orders(edges(spark, d), table(spark, d, "supplier").where("s_suppkey <= 10").select(F.concat(F.lit("s"), "s_suppkey").alias("node")), 5)


@R.add("G3", f"{_LEVELS} SELECT node, level, level = max(level) OVER () AS frontier FROM levels")
def g3(spark, d):
    lv = _levels(spark, d)
    top = lv.agg(F.max("level").alias("top"))
    return lv.join(F.broadcast(top)).select("node", "level", (_c("level") == _c("top")).alias("frontier"))


@R.add("G4", f"{_LEVELS} SELECT l.node, l.level FROM levels l WHERE l.level > 0 AND l.node <> 'x' AND NOT EXISTS (SELECT 1 FROM edges e JOIN levels c ON c.node = e.src WHERE e.dst = l.node AND c.level = l.level - 1)")
def g4(spark, d):
    """Nodes of an order without a child of the one below: none in a sound graph."""
    lv = _levels(spark, d)
    support = edges(spark, d).join(lv.toDF("src", "child_level"), "src").select(_c("dst").alias("node"), (_c("child_level") + 1).alias("level"))
    return lv.where("level > 0 and node <> 'x'").join(support, ["node", "level"], "left_anti")


@R.add("G5", f"WITH RECURSIVE {EDGES}, seen AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey <= 20 UNION SELECT e.dst FROM seen s JOIN edges e ON e.src = s.node) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM seen)")
def g5(spark, d):
    e = edges(spark, d)
    roots = table(spark, d, "customer").where("c_custkey <= 20").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return e.join(G.reachable(e, roots).withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")


_DAG = "dag AS (SELECT n_nationkey::BIGINT AS id, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 100 + r_regionkey, 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 200 + s_suppkey, 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 9000, 'world', 'all')"


def _dag(spark, d):
    t = lambda n: table(spark, d, n)
    return t("nation").selectExpr("cast(n_nationkey as bigint) id", "'n' || n_nationkey src", "'r' || n_regionkey dst").union(t("region").selectExpr("100 + r_regionkey", "'r' || r_regionkey", "'world'")).union(t("supplier").selectExpr("200 + s_suppkey", "'s' || s_suppkey", "'n' || s_nationkey")).union(spark.createDataFrame([(9000, "world", "all")], "id bigint, src string, dst string"))


_OBL = f"WITH RECURSIVE {_DAG}, pred AS (SELECT a.id, b.id AS pred FROM dag a JOIN dag b ON a.src = b.dst), depth AS (SELECT id, 0 AS depth FROM dag WHERE id NOT IN (SELECT id FROM pred) UNION SELECT p.id, d.depth + 1 FROM pred p JOIN depth d ON d.id = p.pred)"


@R.add("G6", f"{_OBL} SELECT g.id, coalesce((SELECT list(DISTINCT pred ORDER BY pred) FROM pred p WHERE p.id = g.id), []) AS parents, (SELECT max(depth) FROM depth x WHERE x.id = g.id) AS depth FROM dag g")
def g6(spark, d):
    return G.obligations(_dag(spark, d))


@R.add("G7", f"WITH {_DAG} SELECT DISTINCT id, substr(sha256(id || ':' || b), 1, 12) AS child, b AS branch FROM dag, (SELECT unnest(['yes', 'no']) AS b)")
def g7(spark, d):
    """An obligation's branches as children, each id once."""
    e = _dag(spark, d).withColumn("branch", F.explode(F.array(F.lit("yes"), F.lit("no"), F.lit("yes"))))
    return e.select("id", F.substring(F.sha2(F.concat_ws(":", "id", "branch"), 256), 1, 12).alias("child"), "branch").dropDuplicates(["child"])


@R.add("G8", f"{_OBL} SELECT g.id, CASE WHEN leaf AND n = 0 THEN 'leaf-without-outcome' WHEN NOT leaf AND n > 0 THEN 'outcome-on-inner' END AS error FROM (SELECT id, id NOT IN (SELECT pred FROM pred) AS leaf, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS n FROM dag) g WHERE (leaf AND n = 0) OR (NOT leaf AND n > 0)")
def g8(spark, d):
    """Leaves have one outcome, inner obligations none."""
    e = _dag(spark, d)
    outcomes = e.where("id % 4 = 0").groupBy("id").agg(F.count("*").alias("n"))
    inner = e.alias("a").join(e.alias("b"), _c("a.src") == _c("b.dst")).select(_c("b.id").alias("id")).distinct().withColumn("inner", F.lit(True))
    j = e.select("id").join(outcomes, "id", "left").join(inner, "id", "left")
    return j.select("id", F.when(_c("inner").isNull() & _c("n").isNull(), "leaf-without-outcome").when(_c("inner") & (_c("n") > 0), "outcome-on-inner").alias("error")).where("error is not null")


@R.add("G9", f"{with_('rel')} SELECT substr(sha256(target || '>' || owner), 1, 12) AS edge, target, owner, count(*) AS evidence, CASE WHEN bool_or(confidence = 'exact') THEN 'confirmed' ELSE 'candidate' END AS status FROM rel WHERE relation IN ('construct', 'field-write') AND NOT dynamic GROUP BY target, owner")
def g9(spark, d):
    """Owner candidates as hashed edges, confirmed by exact evidence."""
    r = relations(spark, d).where("relation in ('construct', 'field-write') and not dynamic").groupBy("target", "owner").agg(F.count("*").alias("evidence"), F.bool_or(_c("confidence") == "exact").alias("exact"))
    return r.select(F.substring(F.sha2(F.concat_ws(">", "target", "owner"), 256), 1, 12).alias("edge"), "target", "owner", "evidence", F.when(_c("exact"), "confirmed").otherwise("candidate").alias("status"))


@R.add("G10", f"{with_('rel')} SELECT owner, target, arg_max(confidence, id) AS confidence FROM rel WHERE relation = 'call' GROUP BY owner, target")
def g10(spark, d):
    """Later edges replace earlier ones of the same ends."""
    return relations(spark, d).where("relation = 'call'").groupBy("owner", "target").agg(F.max_by("confidence", "id").alias("confidence"))


@R.add("G12", f"{with_('sym')} SELECT t.seed, CASE WHEN t.seed = '' THEN 'missing' WHEN count(DISTINCT s.file) = 0 THEN 'not-found' WHEN count(DISTINCT s.file) = 1 THEN 'selected' ELSE 'ambiguous' END AS outcome FROM (VALUES ('app.Cust1.n1'), ('app.Cust1.n2'), ('none'), ('')) t(seed) LEFT JOIN sym s ON s.qualified_name = t.seed GROUP BY t.seed")
def g12(spark, d):
    seeds = spark.createDataFrame([("app.Cust1.n1",), ("app.Cust1.n2",), ("none",), ("",)], "seed string")
    n = symbols(spark, d).groupBy(_c("qualified_name").alias("seed")).agg(F.countDistinct("file").alias("n"))
    j = seeds.join(n, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("seed", F.when(_c("seed") == "", "missing").when(_c("n") == 0, "not-found").when(_c("n") == 1, "selected").otherwise("ambiguous").alias("outcome"))


def diffs(spark, d):
    """A diff for each order: a source, a test (every fifth new, every seventh of the others deleted) and, every third, a picture."""
    o = table(spark, d, "orders")
    name, k = F.concat(F.lit("src/f"), (_c("o_custkey") % 9).cast("string"), F.lit(".js")), _c("o_orderkey")
    text = F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), (_c("o_custkey") % 90 + 1).cast("string"), F.lit(",3 +"), (_c("o_custkey") % 80 + 1).cast("string"),
        F.lit(",6 @@\n keep\n-const OLD_FLAG = \"o\";\n+function price"), (k % 5).cast("string"), F.lit("(x) {\n+  bus.sendEvent(\"saved\"); limit = 10;\n+  if (isEnabled(\"beta\")) callback(\"done\");\n+  const NEW_TOGGLE = \"n\"; choice === \"yes\";\n+  password = \"p\";\n keep\n"),
        F.lit("diff --git a/tests/t.test.js b/tests/t.test.js\n"), F.when(k % 5 == 0, F.lit("new file mode 100644\n")).when(k % 7 == 0, F.lit("deleted file mode 100644\n")).otherwise(F.lit("")),
        F.lit("--- a/tests/t.test.js\n+++ b/tests/t.test.js\n@@ -1,2 +1,3 @@\n+test(\"adds up\", () => {\n+  const noise = 1;\n-it(\"was here\", done);\n same\n"),
        F.when(k % 3 == 0, F.lit("diff --git a/img/x.png b/img/x.png\nBinary files a/img/x.png and b/img/x.png differ\n")).otherwise(F.lit("")),
    )
    return o.select(k.alias("diff_id"), text.alias("diff"), "o_custkey")


_SRC = "o_orderkey AS diff_id, 'src/f' || (o_custkey % 9) || '.js' AS path"
_ADDED = "unnest([{'k': 2, 't': 'function price' || (o_orderkey % 5) || '(x) {'}, {'k': 3, 't': '  bus.sendEvent(\"saved\"); limit = 10;'}, {'k': 4, 't': '  if (isEnabled(\"beta\")) callback(\"done\");'}, {'k': 5, 't': '  const NEW_TOGGLE = \"n\"; choice === \"yes\";'}, {'k': 6, 't': '[REDACTED: potential secret]'}])"


@R.add("SRC13", f"""SELECT {_SRC}, 'deleted' AS type, (o_custkey % 90 + 2)::INT AS line, 'const OLD_FLAG = "o";' AS text FROM orders
UNION ALL SELECT diff_id, path, 'added', (hunk + a.k - 1)::INT, a.t FROM (SELECT {_SRC}, o_custkey % 80 + 1 AS hunk, {_ADDED} AS a FROM orders)
UNION ALL SELECT o_orderkey, 'tests/t.test.js', 'added', 1, 'test("adds up", () => {{' FROM orders UNION ALL SELECT o_orderkey, 'tests/t.test.js', 'deleted', 1, 'it("was here", done);' FROM orders""")
def src13(spark, d):
    return D.diff_lines(diffs(spark, d)).select("diff_id", "path", "type", "line", "text")


@R.add("SRC16", "SELECT o_orderkey AS diff_id, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS files, list_concat(['src/f' || (o_custkey % 9) || '.js', 'tests/t.test.js'], CASE WHEN o_orderkey % 3 = 0 THEN ['img/x.png'] ELSE [] END) AS paths FROM orders")
def src16(spark, d):
    return D.sections(diffs(spark, d)).groupBy("diff_id").agg(F.count("*").alias("files"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("paths"))


@R.add("EXT10", f"""SELECT {_SRC}, false AS test, false AS generated, false AS binary, 'updated' AS change FROM orders
UNION ALL SELECT o_orderkey, 'tests/t.test.js', true, false, false, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'updated' END FROM orders
UNION ALL SELECT o_orderkey, 'img/x.png', false, false, true, 'updated' FROM orders WHERE o_orderkey % 3 = 0""")
def ext10(spark, d):
    s = D.sections(diffs(spark, d))
    return s.select("diff_id", "path", *[c.alias(k) for k, c in D.classify(_c("path"), _c("section")).items()])


_FACTS = "unnest([{'k': 2, 't': 'symbol', 'v': 'price' || (o_orderkey % 5)}, {'k': 3, 't': 'event', 'v': 'saved'}, {'k': 3, 't': 'rule', 'v': 'bus.sendEvent(\"saved\"); limit = 10;'}, {'k': 4, 't': 'feature_flag', 'v': 'beta'}, {'k': 4, 't': 'callback_value', 'v': 'beta'}, {'k': 4, 't': 'callback_value', 'v': 'done'}, {'k': 5, 't': 'feature_flag', 'v': 'n'}, {'k': 5, 't': 'toggle_binding', 'v': 'NEW_TOGGLE'}, {'k': 5, 't': 'callback_value', 'v': 'yes'}])"
_CAND = f"""SELECT diff_id, path, (hunk + f.k - 1)::INT AS line, f.t AS type, f.v AS value FROM (SELECT {_SRC}, o_custkey % 80 + 1 AS hunk, {_FACTS} AS f FROM orders)
UNION ALL SELECT diff_id, path, (hunk + 1)::INT, f.t, f.v FROM (SELECT {_SRC}, o_custkey % 90 + 1 AS hunk, unnest([{{'t': 'feature_flag', 'v': 'o'}}, {{'t': 'toggle_binding', 'v': 'OLD_FLAG'}}]) AS f FROM orders)
UNION ALL SELECT o_orderkey, 'tests/t.test.js', 1, CASE WHEN o_orderkey % 5 = 0 THEN 'test_added' WHEN o_orderkey % 7 = 0 THEN 'test_removed' ELSE 'test_updated' END, 'adds up' FROM orders
UNION ALL SELECT o_orderkey, 'tests/t.test.js', 1, CASE WHEN o_orderkey % 5 = 0 THEN 'test_added' ELSE 'test_removed' END, 'was here' FROM orders"""


@R.add("EXT9", _CAND)
def ext9(spark, d):
    return D.candidates(D.diff_lines(diffs(spark, d))).select("diff_id", "path", "line", "type", "value")


@R.add("EXT11", "SELECT o_orderkey AS diff_id, true AS flags, true AS tests, true AS events, 'events,flags,tests' AS reasons, 'expanded' AS route FROM orders")
def ext11(spark, d):
    """Complexity signals over a diff's facts, and the route that they give."""
    l = D.candidates(D.diff_lines(diffs(spark, d))).groupBy("diff_id").agg(F.bool_or(_c("type").isin("feature_flag", "toggle_binding")).alias("flags"), F.bool_or(_c("type").startswith("test_")).alias("tests"), F.bool_or(_c("type") == "event").alias("events"))
    reasons = F.array_compact(F.array(F.when(_c("events"), F.lit("events")), F.when(_c("flags"), F.lit("flags")), F.when(_c("tests"), F.lit("tests"))))
    return l.select("diff_id", "flags", "tests", "events", F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) > 0, "expanded").otherwise("simple").alias("route"))


@R.add("AGG19", f"WITH c AS ({_CAND}) SELECT path, type, count(DISTINCT value) AS n, list(DISTINCT value ORDER BY value)[1:6] AS first FROM c GROUP BY path, type")
def agg19(spark, d):
    """Facts of each file by type, six of each shown."""
    c = D.candidates(D.diff_lines(diffs(spark, d))).groupBy("path", "type").agg(F.array_sort(F.collect_set("value")).alias("all"))
    return c.select("path", "type", F.size("all").cast("long").alias("n"), F.slice("all", 1, 6).alias("first"))


@R.add("AGG7", "SELECT l_orderkey AS diff_id, sum(CASE WHEN l_linenumber <> 3 THEN l_quantity::BIGINT END)::BIGINT AS insertions, sum(CASE WHEN l_linenumber <> 3 THEN l_linenumber END)::BIGINT AS deletions, count(*) AS files, count(*) FILTER (l_linenumber = 3) AS binary FROM lineitem GROUP BY 1")
def agg7(spark, d):
    l = table(spark, d, "lineitem")
    text = F.when(_c("l_linenumber") == 3, F.lit("-\t-\ta.png")).otherwise(F.concat_ws("\t", _c("l_quantity").cast("long"), "l_linenumber", F.lit("a.js")))
    return D.numstat(l.select(_c("l_orderkey").alias("diff_id"), text.alias("t")), "t")


@R.add("SRC14", "SELECT o_orderkey AS diff_id, 'a' || o_custkey AS path, 'M' AS status FROM orders UNION ALL SELECT o_orderkey, 'b', CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'D' END FROM orders")
def src14(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("M\x00a"), "o_custkey", F.lit("\x00"), F.when(_c("o_orderkey") % 2 == 0, "A").otherwise("D"), F.lit("\x00b\x00"))
    return D.name_status(o.select(_c("o_orderkey").alias("diff_id"), text.alias("t")), "t")


@R.add("SRC15", "SELECT o_orderkey AS diff_id, sha256('base' || o_orderkey) AS base, 2::BIGINT AS files FROM orders")
def src15(spark, d):
    """A review's snapshot: its commits with the number of changed files."""
    o = table(spark, d, "orders")
    snap = o.select(_c("o_orderkey").alias("diff_id"), F.sha2(F.concat(F.lit("base"), "o_orderkey"), 256).alias("base"))
    return snap.join(src14(spark, d).groupBy("diff_id").agg(F.count("*").alias("files")), "diff_id")


@R.add("SRC12", "SELECT o_custkey AS branch, count(*) AS commits, 2 + max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS files FROM orders GROUP BY 1")
def src12(spark, d):
    """Collected git scopes: a branch's commits and distinct changed files."""
    s = D.sections(diffs(spark, d)).join(diffs(spark, d).select("diff_id", _c("o_custkey").alias("branch")), "diff_id")
    return s.groupBy("branch").agg(F.countDistinct("diff_id").alias("commits"), F.countDistinct("path").alias("files"))


@R.add("K28", "SELECT o_orderkey, o_orderkey % 3 = 0 AS changed, CASE WHEN o_orderkey % 3 = 0 THEN 'img/x.png' END AS path FROM orders")
def k28(spark, d):
    """Reference surfaces against patch sections: changed or not."""
    s = D.sections(diffs(spark, d)).where("path like 'img/%'").select(_c("diff_id").alias("o_orderkey"), "path")
    return table(spark, d, "orders").join(s, "o_orderkey", "left").select("o_orderkey", _c("path").isNotNull().alias("changed"), "path")


def reports(spark, d):
    c = table(spark, d, "customer")
    text = F.concat(F.lit("# Report "), "c_name", F.lit("\n\nintro\n## Rows\n| a | b |\n| --- | --- |\n| "), "c_mktsegment", F.lit(" | "), _c("c_nationkey").cast("string"), F.lit(" |\n| x | y |\n## Notes\ntext"))
    return c.select("c_custkey", text.alias("text"))


@R.add("SRC20", "SELECT c_custkey, 'Rows' AS title, 1 AS row, [c_mktsegment, c_nationkey::VARCHAR] AS cells FROM customer UNION ALL SELECT c_custkey, 'Rows', 2, ['x', 'y'] FROM customer")
def src20(spark, d):
    return M.table_rows(M.markdown_lines(reports(spark, d), "c_custkey", "text"), "c_custkey").select("c_custkey", "title", "row", "cells")


@R.add("X33", "SELECT c_custkey, ['Conclusion'] AS missing FROM customer")
def x33(spark, d):
    """Required headings that a document lacks."""
    heads = M.markdown_lines(reports(spark, d), "c_custkey", "text").groupBy("c_custkey").agg(F.collect_set("title").alias("have"))
    return heads.select("c_custkey", F.array_except(F.array(F.lit("Rows"), F.lit("Notes"), F.lit("Conclusion")), "have").alias("missing"))


@R.add("X30", "SELECT c_custkey, 2 AS row, 'weak-row' AS error FROM customer")
def x30(spark, d):
    """Table rows with fewer than two meaningful cells."""
    rows = src20(spark, d)
    weak = F.size(F.filter("cells", lambda c: F.length(c) > 1)) < 1
    return rows.where(weak).select("c_custkey", "row", F.lit("weak-row").alias("error"))


@R.add("X29", "SELECT c_custkey, 1 AS row, false AS code, false AS names, c_nationkey < 10 AS weak FROM customer UNION ALL SELECT c_custkey, 2, false, false, true FROM customer")
def x29(spark, d):
    """Cell predicates of report rows."""
    last = F.element_at("cells", -1)
    return src20(spark, d).select("c_custkey", "row", last.rlike("`[^`]+`").alias("code"), last.rlike("expected names").alias("names"), (F.length(last) < 2).alias("weak"))


@R.add("X32", "SELECT 'Rows' AS title, count(*) AS documents, 0::BIGINT AS missing FROM customer UNION ALL SELECT 'Verdict', 0, count(*) FROM customer")
def x32(spark, d):
    have = M.markdown_lines(reports(spark, d), "c_custkey", "text").select("c_custkey", "title").distinct()
    want = F.explode(F.array(F.lit("Rows"), F.lit("Verdict")))
    j = reports(spark, d).select("c_custkey", want.alias("title")).join(have.withColumn("ok", F.lit(1)), ["c_custkey", "title"], "left")
    return j.groupBy("title").agg(F.count("ok").alias("documents"), F.count_if(_c("ok").isNull()).alias("missing"))


QUERIES, ORACLE_SQL = R.queries, R.sql

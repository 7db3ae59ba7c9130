"""Queries of evidence joins, merges, gates and stateful behaviour (J3-J21, AGG8-17, K, X and ST rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import evidence as E
from larkspur.operators import query as O
from larkspur.plans.model import files, lines, occurrences, relations, symbols, with_
from larkspur.plans.queries_search import HITS, hits
from larkspur.plans.registry import Registry
from larkspur.session import keep, shared_dir, table
from larkspur.streaming import log as L
from larkspur.streaming import runs

R = Registry()
_c = F.col


@R.add("J3", f"{with_('rel', 'sym')}, m AS (SELECT DISTINCT owner, name FROM sym WHERE kind LIKE '%method%'), u AS (SELECT name, min(owner) AS owner FROM m GROUP BY name HAVING count(*) = 1) SELECT r.id, CASE WHEN m.owner IS NOT NULL THEN 'exact' WHEN u.owner IS NOT NULL THEN 'resolved' ELSE r.confidence END AS owner_confidence FROM rel r LEFT JOIN m ON m.owner = r.owner AND m.name = replace(r.method, 'm', 'n') LEFT JOIN u ON u.name = replace(r.method, 'm', 'n')")
def j3(spark, d):
    """Owners proved by a method of theirs, or by the only owner of a method of that name."""
    m = symbols(spark, d).where(_c("kind").contains("method")).select("owner", "name").distinct()
    only = m.groupBy("name").agg(F.count("*").alias("n"), F.min("owner").alias("only_owner")).where("n = 1").drop("n")
    r = relations(spark, d).withColumn("name", F.replace("method", F.lit("m"), F.lit("n")))
    j = r.join(m.withColumn("own", F.lit(True)), ["owner", "name"], "left").join(only, "name", "left")
    return j.select("id", F.when(_c("own"), "exact").when(_c("only_owner").isNotNull(), "resolved").otherwise(_c("confidence")).alias("owner_confidence"))


@R.add("J4_model", f"{with_('rel', 'sym')}, s AS (SELECT owner, name, min(inferred_type) AS t, count(*) AS n FROM sym WHERE inferred_type IS NOT NULL GROUP BY owner, name) SELECT r.id, x AS returns FROM rel r JOIN s ON s.owner = r.owner AND s.name = replace(r.method, 'm', 'n') AND s.n = 1, (SELECT unnest(['a', 'b', 'c']) AS x) WHERE r.relation = 'call' AND x <> CASE r.id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END")
def j4_model(spark, d):
    """Call results joined to the one summary of their method; its possible returns exploded, kept by the selector's domain."""
    s = symbols(spark, d).where("inferred_type is not null").groupBy("owner", "name").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    returns = F.explode(F.array(*map(F.lit, "abc")))
    domain = F.element_at(F.array(F.array(F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"))), (_c("id") % 3 + 1).cast("int"))
    r = relations(spark, d).where("relation = 'call'").withColumn("name", F.replace("method", F.lit("m"), F.lit("n")))
    return r.join(s, ["owner", "name"]).select("id", domain.alias("domain"), returns.alias("returns")).where(F.array_contains("domain", _c("returns"))).select("id", "returns")


@R.add("J5", f"{with_('occ')}, t AS (SELECT *, trim(value) AS term FROM occ WHERE confidence = 'exact'), p AS (SELECT term, arg_min(file, file || lpad(start_offset::VARCHAR, 9, '0')) AS producer_file FROM t WHERE repo = 'repo0' GROUP BY term) SELECT p.term, p.producer_file, list(DISTINCT t.repo ORDER BY t.repo) AS consumers FROM p JOIN t ON t.term = p.term AND t.repo <> 'repo0' GROUP BY ALL")
def j5(spark, d):
    """Boundaries: terms that one repository produces and others consume; the first producing file."""
    t = occurrences(spark, d).where("confidence = 'exact'").withColumn("term", F.btrim("value"))
    p = t.where("repo = 'repo0'").groupBy("term").agg(F.min(F.struct("file", "start_offset"))["file"].alias("producer_file"))
    c = t.where("repo <> 'repo0'").groupBy("term").agg(F.array_sort(F.collect_set("repo")).alias("consumers"))
    return p.join(c, "term").select("term", "producer_file", "consumers")


@R.add("J6", f"{with_('occ')}, e AS (SELECT id, trim(value) AS term, file, start_offset FROM occ) SELECT e.id, CASE WHEN count(o.id) = 1 THEN 'exactly-one' WHEN count(o.id) > 1 THEN 'ambiguous' ELSE 'not-found' END AS outcome FROM e LEFT JOIN occ o ON trim(o.value) = e.term AND o.file = e.file AND o.start_offset = e.start_offset AND o.kind IN ('identifier', 'property') GROUP BY e.id")
def j6(spark, d):
    """Expected uses matched by file, term and offsets among the allowed roles."""
    o = occurrences(spark, d).withColumn("term", F.btrim("value"))
    n = o.where(_c("kind").isin("identifier", "property")).groupBy("file", "term", "start_offset").agg(F.count("*").alias("n"))
    j = o.join(n, ["file", "term", "start_offset"], "left")
    return j.select("id", F.when(_c("n") == 1, "exactly-one").when(_c("n") > 1, "ambiguous").otherwise("not-found").alias("outcome"))


@R.add("J7", "SELECT n.n_nationkey, r AS consumer, CASE WHEN count(s.s_suppkey) = 0 THEN 'unverified' ELSE 'covered' END AS status FROM nation n, (SELECT unnest(['a', 'b']) AS r) LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND CASE WHEN s.s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END = r GROUP BY ALL")
def j7(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("consumer"))
    s = table(spark, d, "supplier").select(_c("s_nationkey").alias("n_nationkey"), F.when(_c("s_suppkey") % 2 == 0, "a").otherwise("b").alias("consumer")).distinct().withColumn("ok", F.lit(1))
    return n.join(s, ["n_nationkey", "consumer"], "left").select("n_nationkey", "consumer", F.when(_c("ok").isNull(), "unverified").otherwise("covered").alias("status"))


@R.add("J8", f"{HITS} SELECT repo, pattern AS check_id, count(DISTINCT doc_id) AS evidence FROM hits WHERE pattern <> 'num' GROUP BY ALL")
def j8(spark, d):
    """Evidence exploded by provenance, matched to positive checks, grouped into families."""
    positive = spark.createDataFrame([("lic",), ("pw",), ("shout",)], "check_id string")
    by_line = hits(spark, d).groupBy("repo", "doc_id", "line").agg(F.collect_set("pattern").alias("provenance"))
    return by_line.select("repo", "doc_id", F.explode("provenance").alias("check_id")).join(F.broadcast(positive), "check_id").groupBy("repo", "check_id").agg(F.countDistinct("doc_id").alias("evidence"))


@R.add("J9", f"{HITS} SELECT repo, arg_min(line, CASE pattern WHEN 'pw' THEN 0 WHEN 'lic' THEN 1 ELSE 2 END * 1000000000000 + doc_id * 100000 + line) AS anchor_line FROM hits GROUP BY repo")
def j9(spark, d):
    """The first anchor by the order of references, then by place."""
    rank = F.when(_c("pattern") == "pw", 0).when(_c("pattern") == "lic", 1).otherwise(2)
    return hits(spark, d).groupBy("repo").agg(F.min_by("line", F.struct(rank, "doc_id", "line")).alias("anchor_line"))


@R.add("J10", f"{with_('lines')} SELECT l.doc_id, l.line FROM lines l WHERE l.line = 2 AND contains(l.text, 'the')")
def j10(spark, d):
    cand = table(spark, d, "documents").select("doc_id", F.lit(2).alias("line"), F.lit("the").alias("value"))
    return cand.join(lines(spark, d), ["doc_id", "line"]).where(F.contains("text", "value")).select("doc_id", "line")


@R.add("J11", f"{with_('lines')}, q AS (SELECT doc_id, text AS quote FROM lines WHERE line = 2 AND trim(text) <> ''), m AS (SELECT q.doc_id, list(l.line ORDER BY l.line) AS places FROM q JOIN lines l ON l.doc_id = q.doc_id AND l.text = q.quote GROUP BY q.doc_id) SELECT doc_id, CASE WHEN list_contains(places, 1) THEN 'at-line' WHEN len(places) = 1 THEN 'relocated' ELSE 'ambiguous' END AS outcome FROM m")
def j11(spark, d):
    """Quotes said to stand at line 1: there, moved to the one other line that matches, or unclear."""
    q = lines(spark, d).where("line = 2 and trim(text) <> ''").select("doc_id", _c("text").alias("quote"))
    m = lines(spark, d).join(q, "doc_id").where("text = quote").groupBy("doc_id").agg(F.collect_list("line").alias("at"))
    return m.select("doc_id", F.when(F.array_contains("at", 1), "at-line").when(F.size("at") == 1, "relocated").otherwise("ambiguous").alias("outcome"))


CAND = f"{with_('rel')}, cand AS (SELECT id, file, line % 50 AS line, relation AS usage, owner AS alias, field AS term, CASE WHEN confidence = 'exact' THEN 'source-confirmed' ELSE 'candidate' END AS status, repeat('x', (id % 17)::INT) || target AS excerpt FROM rel)"
CANON = "SELECT file, line, usage, min(id) AS id, list(DISTINCT alias ORDER BY alias) AS aliases, list(DISTINCT term ORDER BY term) AS terms, CASE WHEN bool_or(status = 'source-confirmed') THEN 'source-confirmed' ELSE 'candidate' END AS status, arg_max(excerpt, length(excerpt) * 1000000000 - id) AS excerpt, count(*) AS found FROM cand GROUP BY file, line, usage"


def candidates(spark, d):
    return relations(spark, d).select("id", "file", (_c("line") % 50).alias("line"), _c("relation").alias("usage"), _c("owner").alias("alias"), _c("field").alias("term"), F.when(_c("confidence") == "exact", "source-confirmed").otherwise("candidate").alias("status"), F.concat(F.repeat(F.lit("x"), (_c("id") % 17).cast("int")), "target").alias("excerpt"))


def canonical(spark, d):
    return E.canonical(candidates(spark, d), ["file", "line", "usage"], "id")


R.add("AGG8", f"{CAND} {CANON}")(canonical)


@R.add("AGG9", f"{CAND}, canon AS ({CANON}) SELECT alias, list(id ORDER BY id) AS ids FROM (SELECT id, unnest(aliases) AS alias FROM canon) GROUP BY alias")
def agg9(spark, d):
    return E.alias_index(canonical(spark, d))


_RES = "idx AS (SELECT alias, count(*) AS n, min(id) AS id FROM (SELECT id, unnest(aliases) AS alias FROM canon) GROUP BY alias), refs AS (SELECT 'app.Cust' || (c_custkey * 3 % 60) AS ref FROM customer)"


@R.add("J13", f"{CAND}, canon AS ({CANON}), {_RES} SELECT ref, CASE WHEN n = 1 THEN id END AS id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM refs LEFT JOIN idx ON alias = ref")
def j13(spark, d):
    refs = table(spark, d, "customer").select(F.concat(F.lit("app.Cust"), _c("c_custkey") * 3 % 60).alias("ref"))
    return E.resolve(refs, E.alias_index(canonical(spark, d)))


@R.add("J12", f"{CAND}, canon AS ({CANON}) SELECT id, file FROM canon WHERE len(list_filter(aliases, lambda a: a IN ('app.Cust1', 'app.Cust2'))) > 0")
def j12(spark, d):
    """Evidence that any reference reaches, by id or alias: a semi-join over exploded aliases."""
    refs = spark.createDataFrame([("app.Cust1",), ("app.Cust2",)], "alias string")
    c = canonical(spark, d)
    return c.join(c.select("id", F.explode("aliases").alias("alias")).join(F.broadcast(refs), "alias", "left_semi").select("id"), "id", "left_semi").select("id", "file")


@R.add("J20", f"{CAND}, canon AS ({CANON}) SELECT usage AS artifact, count(*) AS selectors, count(DISTINCT file) AS files FROM canon WHERE list_contains(aliases, 'app.Cust5') GROUP BY usage")
def j20(spark, d):
    c = canonical(spark, d).where(F.array_contains("aliases", "app.Cust5"))
    return c.groupBy(_c("usage").alias("artifact")).agg(F.count("*").alias("selectors"), F.countDistinct("file").alias("files"))


@R.add("J14", "SELECT l_orderkey AS id, l_suppkey AS ref FROM lineitem WHERE l_linenumber = 1 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def j14(spark, d):
    """References without a declared id."""
    l = table(spark, d, "lineitem").where("l_linenumber = 1").select(_c("l_orderkey").alias("id"), F.array("l_suppkey").alias("refs"))
    return E.dangling(l, "id", "refs", table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey")


_BA = "b AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, lang, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 5 <> 0)"
_CMP = f"WITH {_BA} SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.n_chars <> b.n_chars"


def _runs(spark, d):
    docs = table(spark, d, "documents")
    after = docs.where("doc_id % 5 <> 0").withColumn("n_chars", _c("n_chars") + F.when(_c("doc_id") % 11 == 0, 1).otherwise(0))
    return docs.where("doc_id % 7 <> 0"), after


@R.add("J15", _CMP)
def j15(spark, d):
    b, a = _runs(spark, d)
    return E.compare(b, a, "doc_id", ["lang", "n_chars"])


@R.add("J16", f"WITH {_BA} SELECT count(*) FILTER (b.doc_id IS NULL) AS added, count(*) FILTER (a.doc_id IS NULL) AS removed, count(*) FILTER (a.n_chars <> b.n_chars) AS changed FROM b FULL JOIN a ON a.doc_id = b.doc_id")
def j16(spark, d):
    b, a = _runs(spark, d)
    c = E.compare(b, a, "doc_id", ["lang", "n_chars"])
    return c.agg(*[F.count_if(_c("change") == k).alias(k) for k in ("added", "removed", "changed")])


@R.add("AGG14", f"WITH {_BA} SELECT (SELECT count(*) FROM b) AS before, (SELECT count(*) FROM a) AS after, (SELECT sum(n_chars) FROM a)::BIGINT - (SELECT sum(n_chars) FROM b)::BIGINT AS chars_delta")
def agg14(spark, d):
    b, a = _runs(spark, d)
    both = b.select(F.lit(0).alias("run"), "n_chars").unionByName(a.select(F.lit(1).alias("run"), "n_chars"))
    return both.agg(F.count_if(_c("run") == 0).alias("before"), F.count_if(_c("run") == 1).alias("after"), (F.sum(F.when(_c("run") == 1, _c("n_chars"))) - F.sum(F.when(_c("run") == 0, _c("n_chars")))).alias("chars_delta"))


@R.add("J17", f"{HITS} SELECT repo AS layer, count(*) FILTER (pattern = 'lic') AS target, count(*) FILTER (pattern = 'num') AS analog, CASE WHEN count(*) FILTER (pattern = 'lic') = 0 THEN 'gap' WHEN count(*) FILTER (pattern = 'num') = 0 THEN 'extra' ELSE 'both' END AS status FROM hits WHERE pattern IN ('lic', 'num') GROUP BY repo")
def j17(spark, d):
    side = lambda p, n: hits(spark, d).where(_c("pattern") == p).groupBy(_c("repo").alias("layer")).agg(F.count("*").alias(n))
    j = side("lic", "target").join(side("num", "analog"), "layer", "full_outer").fillna(0)
    return j.select("layer", "target", "analog", F.when(_c("target") == 0, "gap").when(_c("analog") == 0, "extra").otherwise("both").alias("status"))


@R.add("J18", f"{with_('files')} SELECT path, CASE WHEN repo IN ('src0', 'src1') AND NOT (repo = 'src1' AND contains(path, '/en/')) THEN repo END AS repo, CASE WHEN repo = 'src1' AND contains(path, '/en/') THEN 'ambiguous' WHEN repo IN ('src0', 'src1') THEN 'attributed' ELSE 'outside' END AS outcome FROM files")
def j18(spark, d):
    roots = spark.createDataFrame([("src0", "src0"), ("src1", "src1"), ("src1/en", "inner")], "root string, repo string")
    return E.attribute(files(spark, d).select("path"), F.broadcast(roots))


@R.add("J19", "SELECT count(*) AS overlap FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 4 = 0)")
def j19(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("doc_id % 3 = 0").join(docs.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("overlap"))


@R.add("J21", "SELECT coalesce(p.o, h.o) AS id, CASE WHEN p.o IS NULL THEN 'unknown' WHEN h.o IS NULL THEN 'missing' WHEN h.n > 1 THEN 'duplicate' WHEN p.s <> h.s THEN 'mismatch' ELSE 'passed' END AS status FROM (SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0) p FULL JOIN (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 10 = 1 THEN 2 ELSE 1 END AS n FROM orders WHERE o_orderkey % 5 <> 0) h ON h.o = p.o")
def j21(spark, d):
    """A packet against its hand-off: unknown, missing, duplicate and differing ids."""
    o = table(spark, d, "orders").select(_c("o_orderkey").alias("id"), _c("o_orderstatus").alias("s"))
    echo = o.where("id % 5 <> 0").select("id", F.when(_c("id") % 8 == 0, "X").otherwise(_c("s")).alias("hs"))
    echo = echo.unionByName(echo.where("id % 10 = 1")).groupBy("id").agg(F.max("hs").alias("hs"), F.count("*").alias("n"))
    j = o.where("id % 3 <> 0").join(echo, "id", "full_outer")
    return j.select("id", F.when(_c("s").isNull(), "unknown").when(_c("n").isNull(), "missing").when(_c("n") > 1, "duplicate").when(_c("s") != _c("hs"), "mismatch").otherwise("passed").alias("status"))


_TURNS = "t AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text END AS statement FROM conversations)"


@R.add("AGG10", f"WITH {_TURNS} SELECT conv_id, arg_max(role, turn) AS role, arg_max(statement, turn) FILTER (statement IS NOT NULL) AS statement, list_filter([CASE WHEN count(DISTINCT role) > 1 THEN 'role' END, CASE WHEN count(DISTINCT statement) > 1 THEN 'statement' END], lambda x: x IS NOT NULL) AS conflicts, count(*) AS rows FROM t GROUP BY conv_id")
def agg10(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(_c("turn") % 2 == 0, _c("text")).alias("statement"))
    return E.merge_rows(t, "conv_id", "turn", ["role", "statement"])


@R.add("AGG11", "SELECT conv_id, 'role' AS error FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) > 2")
def agg11(spark, d):
    """The strict merge: conflicts of filled fields as error rows."""
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("n"))
    return E.errors(n, "conv_id", {"role": _c("n") <= 2})


@R.add("AGG12", f"WITH {_TURNS} SELECT CASE role WHEN 'user' THEN 'scenarios' WHEN 'assistant' THEN 'recipients' ELSE 'gaps' END AS collection, conv_id AS id, arg_max(role, turn) AS role, count(*) AS rows FROM t GROUP BY 1, 2")
def agg12(spark, d):
    """Facts routed by kind into collections, merged there by id."""
    route = spark.createDataFrame([("user", "scenarios"), ("assistant", "recipients"), ("system", "gaps")], "role string, collection string")
    t = table(spark, d, "conversations").join(F.broadcast(route), "role")
    return t.groupBy("collection", _c("conv_id").alias("id")).agg(F.max_by("role", "turn").alias("role"), F.count("*").alias("rows"))


@R.add("K4", "SELECT kind, count(*) AS n FROM (SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL SELECT 'part', p_partkey, p_name FROM part) GROUP BY kind")
def k4(spark, d):
    """Facts of several shapes as rows of one, by kind."""
    kinds = [("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("part", "p_partkey", "p_name")]
    rows = E.union([table(spark, d, t).select(F.lit(t).alias("kind"), _c(k).cast("long").alias("id"), _c(n).alias("name")) for t, k, n in kinds])
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@R.add("K6", f"{with_('rel', 'sym', 'occ')} SELECT 'ast' AS adapter, id, file, line FROM rel WHERE relation = 'call' UNION ALL SELECT 'ownership', id, file, line FROM rel WHERE relation = 'construct' UNION ALL SELECT 'graph', id, file, line FROM sym UNION ALL SELECT 'boundary', id, file, start_offset FROM occ UNION ALL SELECT 'source', l_orderkey, 'li', l_linenumber FROM lineitem WHERE l_linenumber = 7")
def k6(spark, d):
    r = relations(spark, d)
    pick = lambda df, a, line="line": df.select(F.lit(a).alias("adapter"), "id", "file", _c(line).cast("int").alias("line"))
    li = table(spark, d, "lineitem").where("l_linenumber = 7").select(_c("l_orderkey").alias("id"), F.lit("li").alias("file"), _c("l_linenumber").alias("line"))
    return E.union([pick(r.where("relation = 'call'"), "ast"), pick(r.where("relation = 'construct'"), "ownership"), pick(symbols(spark, d), "graph"), pick(occurrences(spark, d), "boundary", "start_offset"), pick(li, "source")])


@R.add("K5", f"{CAND}, canon AS ({CANON}) SELECT status, count(*) AS retained, sum(found)::BIGINT AS found, (sum(found) - count(*))::BIGINT AS duplicates FROM canon GROUP BY status")
def k5(spark, d):
    """Candidates prepared: canonical rows with what was found, kept and folded."""
    return canonical(spark, d).groupBy("status").agg(F.count("*").alias("retained"), F.sum("found").alias("found"), (F.sum("found") - F.count("*")).alias("duplicates"))


@R.add("K7", "SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN 'source-confirmed' ELSE 'candidate' END AS status FROM documents")
def k7(spark, d):
    """Candidates against their files' snapshots: confirmed by hash and fragment, else candidates."""
    docs = table(spark, d, "documents")
    snap = docs.select("doc_id", F.split("text", "\n").alias("lines"), F.sha2("text", 256).alias("hash"))
    cand = docs.select("doc_id", F.when(_c("doc_id") % 3 == 1, F.lit("x")).otherwise(F.sha2("text", 256)).alias("expected"), F.get(F.split("text", "\n"), F.lit(0)).alias("fragment"))
    ok = S.anchor_ok(_c("hash"), _c("expected"), _c("lines"), F.lit(1), F.lit(1), _c("fragment"))
    return cand.join(snap, "doc_id").select("doc_id", F.when(ok, "source-confirmed").otherwise("candidate").alias("status"))


@R.add("K23", f"{with_('lines')} SELECT doc_id, sha256(d.text) AS source_hash, l.text AS fragment FROM documents d JOIN lines l USING (doc_id) WHERE l.line = 3")
def k23(spark, d):
    """Hash and fragment of line 3 filled in from one snapshot."""
    docs = table(spark, d, "documents").withColumn("fragment", F.get(F.split("text", "\n"), F.lit(2)))
    return docs.where("fragment is not null").select("doc_id", F.sha2("text", 256).alias("source_hash"), "fragment")


_RULES = "SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_totalprice < 100000 THEN NULL ELSE 'price' END, CASE WHEN o_orderstatus IN ('O', 'F') THEN NULL ELSE 'status' END, CASE WHEN regexp_matches(o_orderpriority, '^[123]') THEN NULL ELSE 'priority' END], lambda x: x IS NOT NULL)) AS error FROM orders"


def _rules(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return E.errors(o, "id", {"price": _c("o_totalprice") < 100000, "status": _c("o_orderstatus").isin("O", "F"), "priority": _c("o_orderpriority").rlike("^[123]")})


R.add("K3", _RULES)(_rules)


@R.add("K12", f"WITH e AS ({_RULES}) SELECT error, count(*) AS n, min(id) AS first FROM e GROUP BY error")
def k12(spark, d):
    return _rules(spark, d).groupBy("error").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@R.add("K9", f"WITH e AS ({_RULES}) SELECT count(DISTINCT id) AS failing, (SELECT count(*) FROM orders) - count(DISTINCT id) AS passing, count(DISTINCT id) = 0 AS ok FROM e")
def k9(spark, d):
    """A gate: rows that fail any rule, rows that pass all."""
    bad = _rules(spark, d).agg(F.countDistinct("id").alias("failing"))
    total = table(spark, d, "orders").agg(F.count("*").alias("n"))
    return bad.join(F.broadcast(total)).select("failing", (_c("n") - _c("failing")).alias("passing"), (_c("failing") == 0).alias("ok"))


@R.add("K10", "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'exhausted' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'advanced' ELSE 'open' END AS decision FROM orders GROUP BY 1")
def k10(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(_c("o_orderstatus") == "O").alias("o"), F.count_if(_c("o_orderstatus") == "F").alias("f"))
    return g.select("o_custkey", F.when(_c("o") == 0, "exhausted").when(_c("f") > 0, "advanced").otherwise("open").alias("decision"))


@R.add("K11", "SELECT r.r_regionkey, t.status AS required FROM region r, (VALUES ('O'), ('F'), ('Z')) t(status) WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = r.r_regionkey AND o.o_orderstatus = t.status)")
def k11(spark, d):
    """Required pairs that no row covers."""
    t = lambda n: table(spark, d, n)
    need = t("region").select("r_regionkey", F.explode(F.array(*map(F.lit, "OFZ"))).alias("required"))
    have = t("orders").join(t("customer"), _c("o_custkey") == _c("c_custkey")).join(t("nation"), _c("c_nationkey") == _c("n_nationkey")).select(_c("n_regionkey").alias("r_regionkey"), _c("o_orderstatus").alias("required")).distinct()
    return need.join(have, ["r_regionkey", "required"], "left_anti")


@R.add("K21", "SELECT s_suppkey AS id, 'nation' AS error FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4) UNION ALL SELECT s_suppkey, 'balance' FROM supplier WHERE s_acctbal < 0")
def k21(spark, d):
    s = table(spark, d, "supplier")
    fk = s.join(table(spark, d, "nation").where("n_regionkey < 4"), _c("s_nationkey") == _c("n_nationkey"), "left_anti").select(_c("s_suppkey").alias("id"), F.lit("nation").alias("error"))
    return fk.unionByName(E.errors(s.withColumnRenamed("s_suppkey", "id"), "id", {"balance": _c("s_acctbal") >= 0}))


@R.add("K24", "SELECT doc_id, len(string_split(text, 'the')) - 1 AS occurrences, CASE WHEN len(string_split(text, 'the')) - 1 >= 20 THEN 'fail' WHEN len(string_split(text, 'the')) - 1 >= 10 THEN 'warn' ELSE 'ok' END AS verdict FROM documents")
def k24(spark, d):
    """A seed's cardinality in each file, against its warning and failing bounds."""
    n = F.size(F.split("text", "the")) - 1
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("occurrences"), F.when(n >= 20, "fail").when(n >= 10, "warn").otherwise("ok").alias("verdict"))


@R.add("K26", f"{HITS} SELECT pattern, count(*) AS matches, count(DISTINCT doc_id) AS files, (SELECT count(*) FROM documents) AS scanned FROM hits GROUP BY pattern")
def k26(spark, d):
    total = table(spark, d, "documents").agg(F.count("*").alias("scanned"))
    return hits(spark, d).groupBy("pattern").agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("files")).join(F.broadcast(total))


@R.add("AGG13", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS raw, sum(CASE WHEN lang = 'en' THEN octet_length(encode(text)) ELSE 0 END)::BIGINT AS visible, ceil(sum(octet_length(encode(text))) / 4.0)::BIGINT AS tokens FROM documents GROUP BY source")
def agg13(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.sum(size).alias("raw"), F.sum(F.when(_c("lang") == "en", size).otherwise(0)).alias("visible"), S.estimate_tokens(F.sum(size)).alias("tokens"))


@R.add("AGG15", f"{HITS} SELECT repo AS family, count(*) AS matches, count(DISTINCT doc_id) AS observations, CASE WHEN bool_or(pattern = 'pw') THEN 'confirmed' WHEN count(*) > 5 THEN 'candidate' ELSE 'open' END AS status FROM hits GROUP BY repo")
def agg15(spark, d):
    g = hits(spark, d).groupBy(_c("repo").alias("family")).agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("observations"), F.bool_or(_c("pattern") == "pw").alias("pw"))
    return g.select("family", "matches", "observations", F.when(_c("pw"), "confirmed").when(_c("matches") > 5, "candidate").otherwise("open").alias("status"))


@R.add("AGG16", f"{with_('occ')} SELECT trim(value) AS term, list(DISTINCT repo ORDER BY repo) AS consumers, list(DISTINCT kind ORDER BY kind) AS kinds FROM occ GROUP BY 1")
def agg16(spark, d):
    return occurrences(spark, d).groupBy(F.btrim("value").alias("term")).agg(F.array_sort(F.collect_set("repo")).alias("consumers"), F.array_sort(F.collect_set("kind")).alias("kinds"))


@R.add("AGG17", f"{CAND}, canon AS ({CANON}) SELECT usage, max(len(aliases))::BIGINT AS most, count(*) AS n, max(len(aliases)) > 3 AS over FROM canon GROUP BY usage")
def agg17(spark, d):
    return canonical(spark, d).groupBy("usage").agg(F.max(F.size("aliases")).cast("long").alias("most"), F.count("*").alias("n"), (F.max(F.size("aliases")) > 3).alias("over"))


@R.add("ST1", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def st1(spark, d):
    """The event log in batch form; tests run the stream itself."""
    return L.numbered(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "sequence")


@R.add("ST2", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS words, doc_id % 3 = 0 AS cached FROM documents")
def st2(spark, d):
    """A content-addressed memo: stored analyses are reused, the others made."""
    docs = table(spark, d, "documents").withColumn("key", F.sha2(F.concat_ws("|", "doc_id", "text"), 256))
    analyze = lambda df: df.select("key", "doc_id", F.size(F.split("text", " ")).cast("long").alias("words"), F.lit(False).alias("cached"))
    cache = analyze(docs.where("doc_id % 3 = 0")).withColumn("cached", F.lit(True))
    everything, _ = L.with_cache(docs, cache, "key", analyze)
    return everything.select("doc_id", "words", "cached")


@R.add("ST7", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def st7(spark, d):
    """Lookups that miss the stored keys."""
    docs = table(spark, d, "documents").withColumn("key", F.sha2(F.concat_ws("|", "text", F.lit("prompt-1"), "doc_id"), 256))
    return docs.join(docs.where("doc_id % 3 = 0").select("key"), "key", "left_anti").select("doc_id")


@R.add("ST12", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'TECHNICALLY_UNREADABLE' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'PENDING_REVIEW' ELSE 'CURRENT' END AS status FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def st12(spark, d):
    """Re-hashed sources: changed, missing and new ones."""
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    new = docs.where("doc_id % 5 <> 0").withColumn("h", F.when(_c("doc_id") % 11 == 0, F.lit("changed")).otherwise(_c("h")))
    return L.stale(docs.where("doc_id % 7 <> 0"), new, "doc_id", "h")


@R.add("ST8", """WITH e AS (SELECT user_id, event_id, ['advance', 'continue', 'checkpoint', 'stop', 'stop'][event_id % 5 + 1] AS action FROM events),
a AS (SELECT *, action = 'advance' AND count(*) FILTER (action = 'advance') OVER (PARTITION BY user_id ORDER BY event_id) > 8 AS refused FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, action ORDER BY event_id) AS run FROM a WHERE NOT refused),
stops AS (SELECT user_id, max(event_id) AS last, arg_max(n, event_id) AS n FROM (SELECT user_id, run, max(event_id) AS event_id, count(*) AS n FROM r WHERE action = 'stop' GROUP BY user_id, run) GROUP BY user_id)
SELECT r.user_id, count(*) FILTER (action = 'advance')::INT AS stage, coalesce(arg_max(CASE action WHEN 'continue' THEN 'running' ELSE 'stopped' END, event_id) FILTER (action <> 'advance'), 'running') AS status,
coalesce(CASE WHEN any_value(s.last) > coalesce(max(event_id) FILTER (action = 'advance'), -1) THEN any_value(s.n) END, 0)::INT AS times, count(*) FILTER (action = 'continue')::INT AS runs
FROM r LEFT JOIN stops s USING (user_id) GROUP BY r.user_id""")
def st8(spark, d):
    """Transitions folded in order into each run's state."""
    action = F.get(F.array(*map(F.lit, ("advance", "continue", "checkpoint", "stop", "stop"))), (_c("event_id") % 5).cast("int"))
    e = table(spark, d, "events").select("user_id", "event_id", action.alias("action"), F.when(action == "stop", "net").alias("reason"), F.lit("d").alias("digest"), F.lit(False).alias("acknowledged"), F.lit(False).alias("goal"))
    return L.folded_states(e, "user_id", "event_id").select("user_id", "stage", "status", "times", "runs")


#: Runs of events: the first starts a run, every other run with a goal; stages are the current ones, but for some.
_RUN_EVENTS = """SELECT user_id AS run, event_id AS n, CASE WHEN k = 1 THEN 'start' ELSE {get}('advance', 'advance', 'advance', 'advance', 'advance', 'continue', 'checkpoint', 'stop', 'stop', 'probe', 'probe', 'complete'){at} END AS action,
 CAST(CASE WHEN event_id % 24 = 0 THEN 0 WHEN event_id % 24 = 9 THEN 2 END AS INT) AS stage, 'a' || event_id AS artifact, 'd' || (user_id % 5) AS digest, CASE WHEN event_id % 12 > 6 THEN 'r' || (user_id % 2) END AS reason, 'go' || (event_id % 4) AS next_action,
 CASE WHEN event_id % 5 > 0 THEN 'p' || (event_id % 7) END AS probe, event_id % 36 = 5 AS acknowledged, CASE WHEN user_id % 2 = 0 AND event_id % 60 <> 17 THEN 'goal' WHEN user_id % 2 = 0 THEN 'other' END AS goal, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events}) x"""
_RUN_FOLD = f"""WITH RECURSIVE e AS ({_RUN_EVENTS.format(get="list_value", at="[event_id % 12 + 1]", events="events")}),
s AS (SELECT run, 0::BIGINT AS k, -1 AS stage, 'running' AS status, NULL::VARCHAR AS reason, NULL::VARCHAR AS digest, 0 AS times, 0 AS runs, 0 AS run_stages, NULL::VARCHAR AS artifact, NULL::VARCHAR AS resume, NULL::VARCHAR AS next_action, NULL::VARCHAR AS goal, []::VARCHAR[] AS probes, 0 AS refused, NULL::VARCHAR AS refusal FROM (SELECT DISTINCT run FROM e)
 UNION ALL SELECT run, k, CASE WHEN ok AND action = 'advance' THEN stage + 1 ELSE stage END, CASE WHEN NOT ok THEN status WHEN action = 'continue' THEN 'running' WHEN action = 'checkpoint' THEN 'stopped' WHEN action = 'stop' THEN CASE WHEN goal IS NOT NULL AND again >= 3 THEN 'blocked' ELSE 'stopped' END WHEN action = 'complete' THEN 'complete' ELSE status END,
  CASE WHEN NOT ok OR action IN ('start', 'probe') THEN reason WHEN action = 'checkpoint' THEN coalesce(e_reason, 'partial-checkpoint') WHEN action = 'stop' THEN e_reason WHEN action = 'complete' THEN 'stage-8-validated' END,
  CASE WHEN ok AND action IN ('stop', 'checkpoint') THEN e_digest ELSE digest END, CASE WHEN NOT ok THEN times WHEN action = 'stop' THEN again WHEN action = 'advance' OR action = 'continue' AND acknowledged THEN 0 ELSE times END,
  runs + (ok AND action = 'continue')::INT, CASE WHEN NOT ok THEN run_stages WHEN action = 'continue' THEN 0 WHEN action = 'advance' THEN run_stages + 1 ELSE run_stages END, CASE WHEN ok AND action = 'advance' THEN e_artifact ELSE artifact END,
  CASE WHEN NOT ok THEN resume WHEN action = 'checkpoint' THEN e_artifact WHEN action IN ('advance', 'complete') THEN NULL ELSE resume END, CASE WHEN NOT ok THEN next_action WHEN action = 'checkpoint' THEN e_next WHEN action IN ('advance', 'complete') THEN NULL ELSE next_action END,
  CASE WHEN ok AND action = 'start' THEN e_goal ELSE goal END, CASE WHEN ok AND action = 'probe' THEN list_append(probes, probe) ELSE probes END, refused + (NOT ok)::INT, CASE WHEN ok THEN refusal ELSE why END
 FROM (SELECT *, why IS NULL AS ok FROM (SELECT s.run, e.k, s.stage, s.status, s.reason, s.digest, s.times, s.runs, s.run_stages, s.artifact, s.resume, s.next_action, s.goal, s.probes, s.refused, s.refusal, e.action, e.reason AS e_reason, e.digest AS e_digest, e.artifact AS e_artifact, e.next_action AS e_next, e.goal AS e_goal, e.probe, e.acknowledged,
   CASE WHEN s.reason IS NOT DISTINCT FROM e.reason AND s.digest IS NOT DISTINCT FROM e.digest THEN s.times + 1 ELSE 1 END AS again,
   CASE e.action WHEN 'continue' THEN CASE WHEN s.status = 'complete' THEN 'complete' WHEN s.status = 'blocked' AND NOT e.acknowledged THEN 'blocked' WHEN s.goal IS NOT NULL AND e.goal IS DISTINCT FROM s.goal THEN 'objective' END
    WHEN 'advance' THEN CASE WHEN coalesce(e.stage, s.stage + 1) <> s.stage + 1 OR s.stage + 1 > 8 THEN 'stage' END WHEN 'probe' THEN CASE WHEN coalesce(e.stage, s.stage + 1) <> s.stage + 1 THEN 'stage' WHEN e.probe IS NULL OR list_contains(s.probes, e.probe) THEN 'probe' END
    WHEN 'complete' THEN CASE WHEN s.stage <> 8 THEN 'open-stages' END END AS why
   FROM s JOIN e ON e.run = s.run AND e.k = s.k + 1)))
SELECT s.run, stage, status, reason, digest, times, runs, run_stages, artifact, resume, next_action, goal, len(probes)::INT AS probes, refused, refusal FROM s JOIN (SELECT run, max(k) AS k FROM s GROUP BY run) USING (run, k)"""
_RUN_STATE = ("run", "stage", "status", "reason", "digest", "times", "runs", "run_stages", "artifact", "resume", "next_action", "goal", "probes", "refused", "refusal")


def _run_events(spark, d):
    names = [c.split()[0] for c in runs.EVENT.split(", ")]
    return spark.sql(_RUN_EVENTS.format(get="element_at(array", at=", CAST(event_id % 12 + 1 AS INT))", events="{events}"), events=table(spark, d, "events")).select(*names)


@R.add("ST8_runs", _RUN_FOLD)
def st8_runs(spark, d):
    """The whole protocol of a run - starts with an objective, stages, checkpoints, stops, probes - as keyed state over a table."""
    return runs.run_states(_run_events(spark, d)).select(*_RUN_STATE)


@R.add("ST8_stream", _RUN_FOLD)
def st8_stream(spark, d):
    """The same from a stream: three thirds of the events, one after the other, state kept between triggers."""
    events, at = keep(_run_events(spark, d), "events"), f"{shared_dir(spark)}/larkspur/runs-{uuid.uuid4().hex}"
    last = events.agg(F.max("n")).first()[0] or 0
    for k in range(3):
        # A run's events of a third are in one file: they come in order.
        events.where(F.floor(_c("n") * 3 / (last + 1)) == k).repartition(2, "run").write.mode("append").parquet(f"{at}/in/third={k}")
    stream = spark.readStream.schema(f"{runs.EVENT}, third int").option("maxFilesPerTrigger", 2).option("latestFirst", False).parquet(f"{at}/in")
    runs.follow(stream, f"{at}/out", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return runs.latest(spark.read.parquet(f"{at}/out")).select(*_RUN_STATE)


@R.add("ST11_stages", "SELECT n_regionkey AS lineage, n_nationkey AS artifact, CASE WHEN n_nationkey < 10 THEN 'retained' ELSE 'superseded' END AS state FROM nation")
def st11_stages(spark, d):
    """A revision forked at a stage: earlier artifacts stay, later ones are superseded but kept."""
    return table(spark, d, "nation").select(_c("n_regionkey").alias("lineage"), _c("n_nationkey").alias("artifact"), F.when(_c("n_nationkey") < 10, "retained").otherwise("superseded").alias("state"))


@R.add("ST13", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def st13(spark, d):
    """Open questions without a receipt."""
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(_c("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").join(r, "o_orderkey", "left_anti").select("o_orderkey")


@R.add("EXT8_events", "SELECT e.event_id, (SELECT arg_max(b.event_id, b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'view' AND b.event_id < e.event_id) AS binding FROM events e WHERE e.event_type = 'purchase'")
def ext8_events(spark, d):
    """As-of: the latest binding before each use, as one running maximum a key."""
    e = table(spark, d, "events").where(_c("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("binding", F.max(F.when(_c("event_type") == "view", _c("event_id"))).over(w)).where("event_type = 'purchase'").select("event_id", "binding")


QUERIES, ORACLE_SQL = R.queries, R.sql

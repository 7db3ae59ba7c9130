"""Queries of the code-model commands (Q rows, groups, set operations) on the derived model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import query as O
from larkspur.plans.model import occurrences, relations, symbols, with_
from larkspur.plans.registry import Registry

R = Registry()
_c = F.col
REL = ["id", "owner", "relation", "field", "target", "source_symbol", "line"]
SYM = ["id", "qualified_name", "name", "kind", "owner", "line"]
_rel, _sym = ", ".join(REL), ", ".join(SYM)
SAME = "({0} <> '' AND {1} <> '' AND ({0} = {1} OR regexp_replace({0}, '^.*[.]', '') = regexp_replace({1}, '^.*[.]', '')))"


def same(a: str, b: str) -> str:
    return SAME.format(a, b)


def _command(name: str, sql: str, command: str, cols: list[str], **options):
    R.add(name, sql)(lambda spark, d: O.run_query(command, relations(spark, d), symbols(spark, d), **options).select(*cols))


WRITES = "(relation LIKE '%write%' OR relation LIKE '%to-field%' OR relation = 'object-field')"
_command("Q2", f"{with_('rel')} SELECT {_rel} FROM rel", "relations", REL)
_command("Q3", f"{with_('sym')} SELECT {_sym} FROM sym WHERE kind = 'class'", "symbols", SYM, kind="class")
_command("Q4", f"{with_('rel')} SELECT {_rel} FROM rel WHERE field = 'f3' AND {same('owner', chr(39) + 'Cust7' + chr(39))}", "fields", REL, owner="Cust7", field="f3")
_command("Q5", f"{with_('sym')} SELECT {_sym} FROM sym WHERE kind LIKE '%method%'", "methods", SYM)
_command("Q6", f"{with_('rel')} SELECT {_rel} FROM rel WHERE relation = 'field-read' AND field = 'f4'", "reads", REL, field="f4")
_command("Q7", f"{with_('rel')} SELECT {_rel} FROM rel WHERE {WRITES}", "writes", REL)
_from_s3 = f"({same('source_symbol', chr(39) + 'app.S3' + chr(39))} OR source_symbol LIKE 'app.S3.%')"
_command("Q8", f"{with_('rel')} SELECT {_rel} FROM rel WHERE relation IN ('call', 'construct') AND ({_from_s3} OR {same('target', chr(39) + 'app.S3' + chr(39))})", "calls", REL, symbol="app.S3")
_command("Q9", f"{with_('rel')} SELECT {_rel} FROM rel WHERE relation IN ('call', 'construct') AND {same('target', chr(39) + 'T5' + chr(39))}", "callers", REL, symbol="T5")
_command("Q10", f"{with_('rel')} SELECT {_rel} FROM rel WHERE relation IN ('call', 'construct') AND {_from_s3}", "callees", REL, symbol="app.S3")
_T = "'T5'"
_owners = f"SELECT id, owner, relation, field, target, source_symbol, line, CASE WHEN {same('target', _T)} THEN 'target' ELSE 'candidate' END AS match_mode FROM rel WHERE ({WRITES} OR relation LIKE 'collection-%') AND ({same('target', _T)} OR len(list_filter(candidate_types, lambda x: {same('x', _T)})) > 0)"
_command("Q11", f"{with_('rel', 'sym')} {_owners} UNION ALL SELECT id, owner, 'local-instance', name, inferred_type, qualified_name, line, 'local' FROM sym WHERE kind = 'variable' AND {same('inferred_type', _T)}", "owners", [*REL, "match_mode"], type_="T5")
_command("SET1", f"{with_('rel', 'sym')} {_owners.replace(_T, chr(39) + 'U2' + chr(39))} UNION ALL SELECT id, owner, 'local-instance', name, inferred_type, qualified_name, line, 'local' FROM sym WHERE kind = 'variable' AND {same('inferred_type', chr(39) + 'U2' + chr(39))}", "owners", [*REL, "match_mode"], type_="U2")
_command("Q12", f"{with_('rel')} SELECT {_rel} FROM rel WHERE relation LIKE 'collection-%'", "collections", REL)
_both = "SELECT id, 'symbol' AS set, owner, qualified_name AS name, kind AS what, file FROM sym UNION ALL SELECT id, 'relation', owner, target, relation, file FROM rel"
_find = lambda *t: f"{with_('sym', 'rel')} SELECT * FROM ({_both}) WHERE " + " OR ".join(f"contains(lower(owner || '|' || name || '|' || what || '|' || file), '{x}')" for x in t)
_command("Q14", _find("cust12", "f33.js"), "find", ["id", "set", "owner", "name", "what", "file"], terms=["Cust12", "f33.js"])
_command("SET2", _find("prototype"), "summary", ["id", "set", "owner", "name", "what", "file"], terms=["prototype"])


@R.add("Q1", f"{with_('occ')} SELECT id, trim(value) AS value, kind, file FROM occ WHERE confidence = 'exact' AND trim(value) IN ('Brand#1', 'Brand#12', 'Brand#3')")
def q1(spark, d):
    terms = spark.createDataFrame([("Brand#1",), (" Brand#12",), ("Brand#3 ",)], "term string").select(S.normalized_term(_c("term")).alias("value"))
    rows = occurrences(spark, d).where("confidence = 'exact'").withColumn("value", S.normalized_term(_c("value")))
    return rows.join(F.broadcast(terms), "value", "left_semi").select("id", "value", "kind", "file")


@R.add("Q15", f"{with_('rel')} SELECT count(*) AS relations, count(DISTINCT file) AS files, count(*) FILTER (dynamic) AS dynamic_rows, count(*) FILTER (method IS NULL) AS without_method FROM rel")
def q15(spark, d):
    return relations(spark, d).agg(F.count("*").alias("relations"), F.countDistinct("file").alias("files"), F.count_if("dynamic").alias("dynamic_rows"), F.count_if(_c("method").isNull()).alias("without_method"))


@R.add("Q16", f"{with_('rel')} SELECT {_rel} FROM rel WHERE {WRITES} AND {same('owner', chr(39) + 'Cust9' + chr(39))} AND field = 'f1'")
def q16(spark, d):
    return O.post_filter(O.run_query("writes", relations(spark, d), symbols(spark, d)), owner="Cust9", field="f1").select(*REL)


_EV = "SELECT owner, relation, field, target, count(DISTINCT (line, confidence)) AS n FROM rel GROUP BY ALL"


@R.add("Q17", f"{with_('rel')} {_EV} HAVING bool_or(line BETWEEN 100 AND 120)")
def q17(spark, d):
    return O.line_range(O.evidence_rows(relations(spark, d)), 100, 120).select("owner", "relation", "field", "target", F.size("evidence").cast("long").alias("n"))


@R.add("Q18", f"{with_('rel')} {_EV} HAVING bool_or(confidence IN ('resolved', 'exact'))")
def q18(spark, d):
    return O.min_confidence(O.evidence_rows(relations(spark, d)), "resolved").select("owner", "relation", "field", "target", F.size("evidence").cast("long").alias("n"))


GKEY = "'g-' || substr(sha256(concat_ws(chr(31), coalesce(nullif(owner, ''), 'unknown'), coalesce(nullif(relation, ''), 'unknown'), coalesce(nullif(coalesce(nullif(field, ''), method), ''), 'unknown'), coalesce(nullif(target, ''), 'unknown'))), 1, 12)"
GROUPS = f"SELECT {GKEY} AS key, count(*) AS items, count(DISTINCT source_symbol) AS source_symbols, arg_min(owner, id) AS owner, arg_min(relation, id) AS relation, arg_min(target, id) AS target, min(id) AS example FROM rel GROUP BY 1"


@R.add("AGG1", f"{with_('rel')} {GROUPS}")
def agg1(spark, d):
    return O.semantic_groups(relations(spark, d))


@R.add("AGG2", f"{with_('rel')} SELECT id, {GKEY} AS key FROM rel")
def agg2(spark, d):
    return relations(spark, d).select("id", O.group_key(_c("owner"), _c("relation"), F.coalesce(F.nullif(_c("field"), F.lit("")), _c("method")), _c("target")).alias("key"))


@R.add("Q19", f"{with_('rel')} SELECT {_rel} FROM rel WHERE owner = 'app.Cust7' AND relation = 'call' AND target = 'pkg.T5' AND coalesce(nullif(field, ''), method, 'unknown') = 'f3'")
def q19(spark, d):
    key = lambda *x: O.group_key(*x)
    own = key(_c("owner"), _c("relation"), F.coalesce(F.nullif(_c("field"), F.lit("")), _c("method")), _c("target"))
    return relations(spark, d).where(own == key(F.lit("app.Cust7"), F.lit("call"), F.lit("f3"), F.lit("pkg.T5"))).select(*REL)


@R.add("Q20", f"{with_('rel')} SELECT id, owner, (SELECT count(*) FROM rel WHERE relation = 'call') AS total, least((SELECT count(*) FROM rel WHERE relation = 'call'), 50) AS returned, (SELECT count(*) FROM rel WHERE relation = 'call') > 50 AS truncated FROM rel WHERE relation = 'call' ORDER BY id LIMIT 50")
def q20(spark, d):
    return O.bounded(relations(spark, d).where("relation = 'call'").select("id", "owner"), 50, ["id"])


@R.add("Q21", f"{with_('rel', 'sym')} SELECT r.id, count(*) AS n FROM rel r JOIN sym s ON regexp_replace(r.target, '^.*[.]', '') = s.inferred_type GROUP BY 1")
def q21(spark, d):
    """Short-name equality as a join key: equal names have equal last segments, so one hashable key is enough."""
    s = symbols(spark, d).where("inferred_type <> ''").groupBy(S.short_name("inferred_type").alias("short")).agg(F.count("*").alias("n"))
    return relations(spark, d).withColumn("short", S.short_name("target")).join(s, "short").select("id", "n")


@R.add("Q22", f"{with_('rel')} SELECT * FROM ({GROUPS}) WHERE regexp_matches(owner, '^(?i)(?:app[.]cust1.*|.*7)$') AND regexp_matches(relation, '^(?i)(?:.*write.*)$')")
def q22(spark, d):
    return O.filter_groups(O.semantic_groups(relations(spark, d)), owner="APP.cust1*, *7", relation="*write*")


@R.add("Q29", f"{with_('rel')} SELECT * FROM ({GROUPS}) WHERE owner = 'app.Cust3' AND target = 'pkg.T1'")
def q29(spark, d):
    selector = {"owner": "app.Cust3", "relation": None, "target": "pkg.T1"}
    out = O.semantic_groups(relations(spark, d))
    for k, v in selector.items():
        out = out if v is None else out.where(_c(k) == v)
    return out


@R.add("Q30", f"""{with_('rel')} SELECT CASE WHEN regexp_matches(relation, 'write|to-field|object-field') THEN 'write' WHEN regexp_matches(relation, 'read|to-return|to-call') THEN 'read'
WHEN regexp_matches(relation, '^(call|construct)') THEN 'call' WHEN regexp_matches(relation, '^collection-') THEN 'store' WHEN regexp_matches(relation, 'import|export') THEN 'dependency' ELSE 'other' END AS usage, count(*) AS n FROM rel GROUP BY 1""")
def q30(spark, d):
    return relations(spark, d).groupBy(O.usage_kind(_c("relation")).alias("usage")).agg(F.count("*").alias("n"))


@R.add("Q31", f"""{with_('rel')} SELECT * FROM (SELECT id, CASE WHEN relation = 'construct' THEN 'construct' WHEN relation LIKE 'collection-%' OR relation = 'object-field' THEN 'contain'
WHEN relation LIKE '%write%' OR relation LIKE '%to-field%' THEN 'transform' WHEN relation = 'field-read' THEN 'read' WHEN relation IN ('import', 'export') THEN 'boundary' END AS edge,
CASE WHEN relation = 'field-read' THEN owner ELSE source_symbol END AS from_name, CASE WHEN relation = 'field-read' THEN source_symbol ELSE owner END AS to_name FROM rel) WHERE edge IS NOT NULL""")
def q31(spark, d):
    read = _c("relation") == "field-read"
    return relations(spark, d).select("id", O.relation_shape(_c("relation")).alias("edge"), F.when(read, _c("owner")).otherwise(_c("source_symbol")).alias("from_name"), F.when(read, _c("source_symbol")).otherwise(_c("owner")).alias("to_name")).where("edge is not null")


@R.add("Q32", f"{with_('rel')} SELECT owner, target, count(DISTINCT line) AS evidence, least(count(DISTINCT line), 3) AS shown, list(DISTINCT line ORDER BY line)[1:3] AS lines, CASE WHEN length(owner || ' in ' || target) > 12 THEN substr(owner || ' in ' || target, 1, 11) || '…' ELSE owner || ' in ' || target END AS snippet FROM rel GROUP BY owner, target")
def q32(spark, d):
    g = relations(spark, d).groupBy("owner", "target").agg(F.array_sort(F.collect_set("line")).alias("all"))
    return g.select("owner", "target", F.size("all").cast("long").alias("evidence"), F.least(F.size("all"), F.lit(3)).cast("long").alias("shown"), F.slice("all", 1, 3).alias("lines"), S.compact_snippet(F.concat("owner", F.lit("  in\t"), "target"), 12).alias("snippet"))


@R.add("EXT4", f"{with_('rel')} SELECT owner, relation, field, target, source_symbol, count(*) AS rows, list(line ORDER BY id) AS lines FROM rel GROUP BY ALL")
def ext4(spark, d):
    g = relations(spark, d).groupBy("owner", "relation", "field", "target", "source_symbol")
    return g.agg(F.count("*").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]).alias("lines"))


@R.add("EXT5", f"{with_('occ')} SELECT trim(value) AS value, kind, file, start_offset, end_offset, max(id) AS id FROM occ GROUP BY ALL")
def ext5(spark, d):
    """Occurrences deduplicated by value, kind, file and range: the last wins."""
    rows = occurrences(spark, d).withColumn("value", S.normalized_term(_c("value")))
    return rows.groupBy("value", "kind", "file", "start_offset", "end_offset").agg(F.max("id").alias("id"))


@R.add("EXT12", f"""{with_('rel', 'sym')} SELECT 'symbols' AS view, count(*) AS n FROM sym UNION ALL SELECT 'fields', count(*) FROM rel WHERE field <> '' UNION ALL SELECT 'methods', count(*) FROM sym WHERE kind LIKE '%method%'
UNION ALL SELECT 'reads', count(*) FROM rel WHERE relation = 'field-read' UNION ALL SELECT 'writes', count(*) FROM rel WHERE {WRITES} UNION ALL SELECT 'calls', count(*) FROM rel WHERE relation IN ('call', 'construct')
UNION ALL SELECT 'collections', count(*) FROM rel WHERE relation LIKE 'collection-%' UNION ALL SELECT 'imports', count(*) FROM rel WHERE relation = 'import' UNION ALL SELECT 'relations', count(*) FROM rel""")
def ext12(spark, d):
    """The nine views of one analysis, counted."""
    r, s = relations(spark, d), symbols(spark, d)
    views = {v: O.run_query(v, r, s) for v in ("symbols", "fields", "methods", "reads", "writes", "calls", "collections", "relations")} | {"imports": r.where("relation = 'import'")}
    out = None
    for name, rows in views.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES, ORACLE_SQL = R.queries, R.sql

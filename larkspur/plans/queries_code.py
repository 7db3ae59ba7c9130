"""Queries of code extraction (SRC11, EXT1-EXT3, EXT6, EXT7, U3, U4) on sources generated from the part table: of many shapes for the token rows, of one for the line patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import domains, syntax
from larkspur.operators.extract import code_rows
from larkspur.operators.returns import possible_returns
from larkspur.plans import shapes
from larkspur.plans.registry import Registry
from larkspur.session import table

R = Registry()
_c = F.col


def sources(spark, d):
    p = table(spark, d, "part")
    k = _c("p_partkey").cast("string")
    text = F.concat(
        F.lit("import { Base } from 'base';\n// class Noise {\nclass Part"), k, F.lit(" extends Base {\n  constructor(size) {\n    this.size = size;\n    this.box = new Box();\n  }\n  save(store) {\n    store.write(this.size);\n    this.items.push(new Item());\n  }\n}\nconst p"),
        k, F.lit(" = new Part"), k, F.lit("(3);\nfunction load(id) {\n  return fetchPart(id);\n}\nPart"), k, F.lit(".prototype.name = function () {\n  return 'new Fake()';\n};\n"), F.when(_c("p_partkey") % 10 == 0, F.lit("function broken() {\n")).otherwise(F.lit("")),
    )
    return p.select(F.concat(F.lit("src/p"), k, F.lit(".js")).alias("file"), text.alias("text"))


def code(spark, d):
    return code_rows(sources(spark, d), "file", "text")


def shaped(spark, d, texts=shapes.SHAPES):
    """(file, text): a source of one of the shapes for each part."""
    p, k = table(spark, d, "part"), _c("p_partkey").cast("string")
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (_c("p_partkey") % len(texts) + 1).cast("int"))
    return p.select(F.concat(F.lit("src/p"), k, F.lit(".js")).alias("file"), F.replace(text, F.lit("@"), k).alias("text"))


_MODELS: dict = {}


def model(spark, d, texts=shapes.SHAPES):
    """The model of a shape's sources, made once an application."""
    key = (spark.sparkContext.applicationId, d, texts)
    if key not in _MODELS:
        _MODELS[key] = syntax.Model(shaped(spark, d, texts))
    return _MODELS[key]


_N = len(shapes.SHAPES)


@R.add("SRC11", f"SELECT 'src/p' || p_partkey || '.js' AS file, coalesce(status, 'ok') AS status, replace(diagnostic, '_', ' ') AS diagnostic FROM part LEFT JOIN {shapes.rows(shapes.OUTCOMES, 'status', 'diagnostic')} ON CAST(x.shape AS BIGINT) = p_partkey % {_N}")
def src11(spark, d):
    """Each file's parse outcome: a failure is a row with a diagnostic."""
    files = shaped(spark, d)
    return syntax.outcomes(files, syntax.tokens(files))


_TEXTS = dict.fromkeys(("kind", "qualified_name", "name", "owner", "method", "params", "scope", "target", "type", "candidate"), "VARCHAR")


@R.add("EXT1", shapes.expected(shapes.SYMBOLS, _N, **_TEXTS, line="INTEGER"))
def ext1(spark, d):
    """Symbols: functions by how they are named, classes and their members, declarations with scope and type, imports and exports."""
    m = model(spark, d)
    return m.symbols(m.declared).select("file", *_TEXTS, "line")


@R.add("EXT1_patterns", " UNION ALL ".join(f"SELECT 'src/p' || p_partkey || '.js' AS file, '{kind}' AS kind, {name} AS name, {owner} AS owner, {line} AS line FROM part" for kind, name, owner, line in (("class", "'Part' || p_partkey", "NULL", 3), ("class-method", "'constructor'", "'Part' || p_partkey", 4), ("class-method", "'save'", "'Part' || p_partkey", 8), ("variable", "'p' || p_partkey", "NULL", 13), ("function", "'load'", "NULL", 14), ("prototype-method", "'name'", "'Part' || p_partkey", 17))) + " UNION ALL SELECT 'src/p' || p_partkey || '.js', 'function', 'broken', NULL, 20 FROM part WHERE p_partkey % 10 = 0")
def ext1_patterns(spark, d):
    """The quick form by line patterns."""
    return code(spark, d).where("row = 'symbol'").select("file", "kind", "name", "owner", "line")


@R.add("U3", shapes.expected(shapes.VISITS, _N, name="VARCHAR", kind="VARCHAR", depth="BIGINT", parent="VARCHAR", enter="BIGINT", leave="BIGINT"))
def u3(spark, d):
    """A walk's visits: when each class and named function is entered and left."""
    return syntax.visits(model(spark, d))


@R.add("EXT3", "SELECT r.kind, count(*) AS n FROM part, (VALUES ('import'), ('parameter-to-field'), ('field-write'), ('construct'), ('construct'), ('construct'), ('call'), ('call'), ('field-read'), ('field-read'), ('collection-push')) r(kind) GROUP BY 1")
def ext3(spark, d):
    return code(spark, d).where("row = 'relation'").groupBy("kind").agg(F.count("*").alias("n"))


@R.add("U4", "SELECT count(DISTINCT 'src/p' || p_partkey) AS files FROM part")
def u4(spark, d):
    """The worker's unit: a partition of files in, rows out."""
    return code(spark, d).agg(F.countDistinct("file").alias("files"))


@R.add("EXT2", shapes.expected(shapes.RESOLVED, _N, scope="VARCHAR", name="VARCHAR", type="VARCHAR", confidence="VARCHAR", via="VARCHAR"))
def ext2(spark, d):
    """Every declared name resolved in its scope, over aliases, with the way there."""
    declared = model(spark, d).declared
    found = syntax.resolved(declared.select("file", "scope", "name"), declared)
    return found.withColumn("via", F.array_join("via", ","))


@R.add("EXT6", "SELECT 'src/p' || p_partkey || '.js' AS file, 'size' AS field, 'candidate' AS confidence FROM part UNION ALL SELECT 'src/p' || p_partkey || '.js', 'box', 'exact' FROM part")
def ext6(spark, d):
    """What a field's value is worth as a type: a constructor is exact, a parameter a candidate."""
    w = code(spark, d).where("row = 'relation' and kind in ('field-write', 'parameter-to-field')")
    return w.select("file", _c("name").alias("field"), F.when(_c("kind") == "field-write", "exact").otherwise("candidate").alias("confidence"))


@R.add("EXT8", shapes.expected(shapes.DOMAIN_ROWS, len(shapes.DOMAINS), scope="VARCHAR", call_line="INTEGER", callee="VARCHAR", position="INTEGER", key="VARCHAR", domain="VARCHAR"))
def ext8(spark, d):
    """The discriminator's possible values of each argument, as of its call: bindings void after what may change them, branches united."""
    found = domains.domains(model(spark, d, shapes.DOMAINS))
    return found.select("file", "scope", "call_line", "callee", "position", "key", F.array_join("domain", ",").alias("domain"))


@R.add("J4", shapes.expected(shapes.FACTORY_ROWS, len(shapes.DOMAINS), call_line="INTEGER", target="VARCHAR", callee="VARCHAR", type="VARCHAR", confidence="VARCHAR"))
def j4(spark, d):
    """Fields set to a method's result, joined to the one summary of that method: its possible returns, picked by the domain of the argument that selects them."""
    return domains.factory_returns(model(spark, d, shapes.DOMAINS))


#: A customer's orders as a method's statements: a body, a case and a default.
_STATEMENTS = """SELECT o_custkey AS method, o_orderkey % 3 AS block, o_orderkey AS seq,
 CASE WHEN kind < 3 THEN 'assign' WHEN kind = 3 THEN 'declare' WHEN kind = 4 THEN 'return' WHEN kind = 5 THEN 'flow' ELSE 'other' END AS kind,
 CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS name, CASE WHEN o_orderkey % 5 < 3 THEN 'T' || CAST(o_orderkey % 4 AS STRING) END AS type,
 CASE WHEN o_orderkey % 3 > 0 THEN 700 END AS switch_seq, CASE WHEN o_orderkey % 3 = 1 THEN 0 END AS parameter,
 CASE WHEN o_orderkey % 3 = 1 THEN 'kind' END AS key, CASE WHEN o_orderkey % 3 = 1 THEN 'c1' END AS case_value
 FROM (SELECT *, CAST(floor(o_orderkey / 3) AS BIGINT) % 7 AS kind FROM orders) o"""


@R.add("EXT7", shapes.expected(shapes.RETURNED, len(shapes.RETURNS), method="VARCHAR", type="VARCHAR", parameter="INTEGER", key="VARCHAR", case_value="VARCHAR"))
def ext7(spark, d):
    """Possible return types of each method of the sources, those of a switch's cases with their selector."""
    found = possible_returns(syntax.statements(model(spark, d, shapes.RETURNS)), "file")
    return found.select("method.file", F.col("method.qualified").alias("method"), "type", "parameter", "key", "case_value")


@R.add("EXT7_rows", f"""WITH s AS ({_STATEMENTS}),
 r AS (SELECT * FROM s WHERE kind = 'return'
  AND NOT EXISTS (SELECT 1 FROM s e WHERE e.method = s.method AND e.block = s.block AND e.kind = 'return' AND e.seq < s.seq)
  AND (switch_seq IS NULL OR NOT EXISTS (SELECT 1 FROM s e WHERE e.method = s.method AND e.block = 0 AND e.kind = 'return' AND e.seq <= s.switch_seq))),
 f AS (SELECT method, block, max(seq) AS final, count(*) FILTER (WHERE kind = 'flow') AS flows FROM s GROUP BY ALL),
 barrier AS (SELECT r.method, r.block, r.seq, coalesce(max(e.seq), -1) AS after FROM r LEFT JOIN s e ON e.method = r.method AND e.block = r.block AND e.kind = 'flow' AND e.seq < r.seq GROUP BY ALL),
 v AS (SELECT b.method, b.block, b.seq, nullif(arg_max(coalesce(x.type, ''), x.seq), '') AS type FROM barrier b JOIN r USING (method, block, seq)
  JOIN s x ON x.method = r.method AND x.block = r.block AND x.name = r.name AND x.kind IN ('declare', 'assign') AND x.seq > b.after AND x.seq < r.seq GROUP BY ALL),
 t AS (SELECT r.method, coalesce(r.type, v.type) AS type, CASE WHEN r.seq = final AND flows = 0 THEN parameter END AS parameter, CASE WHEN r.seq = final AND flows = 0 THEN key END AS key,
  CASE WHEN r.seq = final AND flows = 0 THEN case_value END AS case_value, r.block, r.seq FROM r JOIN f USING (method, block) LEFT JOIN v USING (method, block, seq))
 SELECT method, type, parameter, key, case_value, min({{'block': block, 'seq': seq}}).block AS block, min({{'block': block, 'seq': seq}}).seq AS seq FROM t WHERE type IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def ext7_rows(spark, d):
    """The same on statement rows: any order of statements, any nesting."""
    return possible_returns(spark.sql(_STATEMENTS.replace("FROM orders)", "FROM {orders})"), orders=table(spark, d, "orders")))


QUERIES, ORACLE_SQL = R.queries, R.sql

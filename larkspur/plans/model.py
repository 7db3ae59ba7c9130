"""The engine's model tables, derived from the star schema and the texts: the same SQL on either side.

relations and symbols stand for a code model; lines, files and terms for a searched tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import table

_RELATIONS = """
SELECT o_orderkey AS id, 'app.Cust' || (o_custkey % 40) AS owner,
       CASE o_orderkey % 9 WHEN 0 THEN 'field-read' WHEN 1 THEN 'field-write' WHEN 2 THEN 'call' WHEN 3 THEN 'construct'
            WHEN 4 THEN 'collection-push' WHEN 5 THEN 'parameter-to-field' WHEN 6 THEN 'object-field' WHEN 7 THEN 'import' ELSE 'computed-write' END AS relation,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'f' || (o_orderkey % 11) END AS field,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'm' || (o_orderkey % 7) END AS method,
       'pkg.T' || (o_orderkey % 23) AS target, 'app.S' || (o_custkey % 17) || '.run' AS source_symbol,
       {arr}('pkg.T' || (o_orderkey % 23), 'U' || (o_orderkey % 6)) AS candidate_types,
       CASE o_orderkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'name-inferred' WHEN 2 THEN 'resolved' ELSE 'exact' END AS confidence,
       CAST(o_orderkey % 500 + 1 AS INT) AS line, 'src/f' || (o_custkey % 60) || '.js' AS file, o_orderkey % 13 = 0 AS dynamic
FROM orders
"""
_SYMBOLS = """
SELECT c_custkey AS id, 'app.Cust' || (c_custkey % 40) || '.n' || (c_custkey % 9) AS qualified_name, 'n' || (c_custkey % 9) AS name,
       CASE c_custkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'class-method' WHEN 3 THEN 'prototype-method' WHEN 4 THEN 'variable' ELSE 'import' END AS kind,
       'app.Cust' || (c_custkey % 40) AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'T' || (c_custkey % 23) END AS inferred_type,
       CAST(c_nationkey AS INT) AS line, 'src/f' || (c_custkey % 60) || '.js' AS file
FROM customer
"""
_OCCURRENCES = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_brand ELSE p_brand END AS value,
       CASE p_partkey % 3 WHEN 0 THEN 'identifier' WHEN 1 THEN 'property' ELSE 'string' END AS kind,
       'repo' || (p_partkey % 5) AS repo, 'src/f' || (p_partkey % 30) || '.js' AS file, p_size AS start_offset, p_size + 5 AS end_offset,
       CASE WHEN p_partkey % 7 = 0 THEN 'candidate' ELSE 'exact' END AS confidence
FROM part
"""
_FILES = """
SELECT doc_id, source AS repo, source || '/' || lang || '/doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' ELSE '.png' END AS path, text FROM documents
"""

#: DuckDB common table expressions, to be put after WITH.
CTE = {
    "rel": f"rel AS ({_RELATIONS.format(arr='list_value')})",
    "sym": f"sym AS ({_SYMBOLS})",
    "occ": f"occ AS ({_OCCURRENCES})",
    "files": f"files AS ({_FILES})",
    "lines": "lines AS (SELECT doc_id, source AS repo, CAST(i AS INT) AS line, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names)


def _from(spark: SparkSession, sf_dir: str, base: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(arr="array").replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "orders", _RELATIONS)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "customer", _SYMBOLS)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "part", _OCCURRENCES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "documents", _FILES)


def lines(spark: SparkSession, sf_dir: str, wanted: Column | None = None) -> DataFrame:
    """(doc_id, repo, line, text): one row a line, counted from 1; only of documents that are wanted, a condition on their text."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if wanted is None else docs.where(wanted)
    return docs.select("doc_id", F.col("source").alias("repo"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", "repo", (F.col("pos") + 1).cast("int").alias("line"), "text")

"""A caller's rows as one struct, so that their columns clash with nothing that an operator names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordered import looked_up

__all__ = ["looked_up", "unwrapped", "wrapped"]


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, own_id, ...): each row whole, its doc_id as a long, and more columns over docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), *[c.alias(name) for name, c in more.items()])


def unwrapped(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The caller's columns again, some of them replaced."""
    return df.select(*[instead[c].alias(c) if c in instead else F.col("row")[c].alias(c) for c in columns])


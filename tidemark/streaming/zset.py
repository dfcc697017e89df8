"""Bags as weighted rows: a column of whole-number weights beside the row's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linear import WEIGHT


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def negated(df: DataFrame) -> DataFrame:
    return df.withColumn(WEIGHT, -F.col(WEIGHT))


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != WEIGHT]


def consolidated(df: DataFrame) -> DataFrame:
    """Each distinct row once with its total weight, without rows of weight 0. Nulls are equal here, as are NaNs."""
    own = [F.col(f"`{c}`") for c in columns(df)]
    total = F.sum(WEIGHT).cast("long").alias(WEIGHT)
    return (df.groupBy(*own).agg(total) if own else df.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).cast("long").alias(WEIGHT))).where(F.col(WEIGHT) != 0)


def added(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    return consolidated(added(new, negated(old)))


def expanded(df: DataFrame) -> DataFrame:
    """Plain rows, each as often as its weight says; a negative weight is an error."""
    copies = F.when(F.col(WEIGHT) < 0, F.raise_error(F.lit("a row's multiplicity fell below zero"))).otherwise(F.array_repeat(F.lit(0), F.col(WEIGHT).cast("int")))
    one = F.col(WEIGHT) == 1
    return df.withColumn("__copy", F.explode(F.when(one, F.array(F.lit(0))).otherwise(copies))).drop("__copy", WEIGHT)

"""Scan, Filter, Project and Distinct. The first three pass a weight column through, if there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rendering import Renderer
from ..plans.model import Distinct, Filter, Project, Scan

WEIGHT = "__w"


def weight(df: DataFrame) -> list[str]:
    return [WEIGHT] if WEIGHT in df.columns else []


def scan(stage: Scan, df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(s) for c, s in zip(stage.columns, stage.outputs)), *weight(df))


def filtered(stage: Filter, df: DataFrame) -> DataFrame:
    return df.where(Renderer(df)(stage.predicate))


def projected(stage: Project, df: DataFrame) -> DataFrame:
    r = Renderer(df)
    return df.selectExpr(*(f"{r(e)} AS `{s}`" for e, s in zip(stage.expressions, stage.outputs)), *weight(df))


def distinct(stage: Distinct, df: DataFrame) -> DataFrame:
    return df.distinct()

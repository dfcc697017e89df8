"""UNION, INTERSECT and EXCEPT, with and without ALL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.model import SetOperation


def set_operation(stage: SetOperation, left: DataFrame, right: DataFrame) -> DataFrame:
    left, right = left.toDF(*stage.outputs), right.toDF(*stage.outputs)
    match stage.kind:
        case "union all":
            return left.union(right)
        case "union":
            return left.union(right).distinct()
        case "intersect":
            return left.intersect(right)
        case "intersect all":
            return left.intersectAll(right)
        case "except":
            return left.subtract(right)
    return left.exceptAll(right)

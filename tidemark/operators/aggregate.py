"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import render
from ..functions.rendering import Renderer
from ..plans.model import Aggregate


def aggregate(stage: Aggregate, df: DataFrame) -> DataFrame:
    """One row per group, null keys forming one; without groups always one row."""
    r = Renderer(df)
    n = len(stage.groups)
    groups = [F.expr(r(g)).alias(s) for g, s in zip(stage.groups, stage.outputs)]
    calls = [F.expr(render(c, r)).alias(s) for c, s in zip(stage.aggregates, stage.outputs[n:])]
    if not groups:
        return df.agg(*calls) if calls else df.sparkSession.range(1).select()
    return df.groupBy(*groups).agg(*calls) if calls else df.select(*groups).distinct()

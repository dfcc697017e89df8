"""ORDER BY with LIMIT, OFFSET and WITH TIES."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rendering import Renderer
from ..plans.model import TopN


def _keys(stage: TopN, df: DataFrame) -> list:
    r = Renderer(df)
    made = []
    for k in stage.order:
        c = F.expr(r(k.expr))
        made.append((c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()) if k.descending else (c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()))
    return made


def top_n(stage: TopN, df: DataFrame) -> DataFrame:
    keys = _keys(stage, df)
    if stage.limit is None:
        return df.orderBy(*keys).offset(stage.offset) if keys else df.offset(stage.offset)
    if stage.limit == 0:
        return df.limit(0)
    end = stage.offset + stage.limit
    if not stage.ties:
        return df.orderBy(*keys).offset(stage.offset).limit(stage.limit)
    # The last row taken bounds the ties: only rows that don't sort after it are taken, and ranked, in one task, if some are to be skipped.
    r = Renderer(df)
    columns = [f"__k{i}" for i in range(len(stage.order))]
    keyed = df.selectExpr("*", *(f"{r(k.expr)} AS {c}" for k, c in zip(stage.order, columns)))
    by = [(F.col(c).desc_nulls_first() if k.nulls_first else F.col(c).desc_nulls_last()) if k.descending else (F.col(c).asc_nulls_first() if k.nulls_first else F.col(c).asc_nulls_last()) for k, c in zip(stage.order, columns)]
    w = Window.orderBy(*by)
    head = keyed.select(*columns).orderBy(*by).limit(end)
    last = head.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == end).select(*(F.col(c).alias(f"{c}_b") for c in columns), F.lit(True).alias("__full"))
    near = keyed.join(F.broadcast(last), F.lit(True), "left")
    after = F.lit(False)
    for k, c in reversed(list(zip(stage.order, columns))):
        a, b = F.col(c), F.col(f"{c}_b")
        strictly = F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNotNull()) if not k.nulls_first else (a.isNotNull() & b.isNull())).otherwise((a < b) if k.descending else (a > b))
        after = strictly | (a.eqNullSafe(b) & after)
    near = near.where(F.col("__full").isNull() | ~after)
    if not stage.offset:  # all of these, and nothing to rank
        return near.select(*(F.col(f"`{c}`") for c in df.columns))
    ranked = near.withColumn("__rn", F.row_number().over(w)).withColumn("__rk", F.rank().over(w))
    return ranked.where((F.col("__rn") > stage.offset) & (F.col("__rk") <= end)).select(*df.columns)

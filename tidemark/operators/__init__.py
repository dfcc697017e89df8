"""Operators on bags of rows: each a function of plain DataFrames. Catalyst chooses how they run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.model import Aggregate, Distinct, Filter, Join, Plan, Project, Scan, SetOperation, Stage, TopN, Window
from .aggregate import aggregate
from .join import join, join_many
from .linear import distinct, filtered, projected, scan
from .setops import set_operation
from .topn import top_n
from .window import window


def apply(stage: Stage, *inputs: DataFrame) -> DataFrame:
    """The stage's result over full inputs."""
    match stage:
        case Scan():
            return scan(stage, *inputs)
        case Filter():
            return filtered(stage, *inputs)
        case Project():
            return projected(stage, *inputs)
        case Join():
            return join(stage, *inputs)
        case Distinct():
            return distinct(stage, *inputs)
        case Aggregate():
            return aggregate(stage, *inputs)
        case Window():
            return window(stage, *inputs)
        case TopN():
            return top_n(stage, *inputs)
        case SetOperation():
            return set_operation(stage, *inputs)
    raise TypeError(type(stage).__name__)


def apply_above(top: Stage, below: Stage, rows: DataFrame) -> DataFrame:
    """The stages from top down to below, without it, over below's rows; each has one input."""
    return rows if top is below else apply(top, apply_above(top.inputs[0], below, rows))


def evaluate(plan: Plan, table: Callable[[str], DataFrame]) -> DataFrame:
    """The plan's result over full tables, by its column names."""

    def run(stage: Stage) -> DataFrame:
        return apply(stage, table(stage.table)) if isinstance(stage, Scan) else apply(stage, *map(run, stage.inputs))

    return run(plan.top).toDF(*plan.names)

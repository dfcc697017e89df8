"""The plan: a tree of operators over relations whose columns are slots. Expressions of a stage speak of its inputs' slots."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.tree import Call, Frame, Node, Over, SortKey


@dataclass(frozen=True)
class Stage:
    """outputs: slots in order."""

    outputs: tuple[str, ...]

    @property
    def inputs(self) -> tuple[Stage, ...]:
        return ()


@dataclass(frozen=True)
class Scan(Stage):
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class OneInput(Stage):
    child: Stage

    @property
    def inputs(self) -> tuple[Stage, ...]:
        return (self.child,)


@dataclass(frozen=True)
class Filter(OneInput):
    predicate: Node


@dataclass(frozen=True)
class Project(OneInput):
    expressions: tuple[Node, ...]


@dataclass(frozen=True)
class Distinct(OneInput):
    pass


@dataclass(frozen=True)
class Aggregate(OneInput):
    """outputs: the groups, then the aggregates."""

    groups: tuple[Node, ...]
    aggregates: tuple[Call, ...]


@dataclass(frozen=True)
class Window(OneInput):
    """outputs: the child's slots, then the functions; over has partition and order, frame is set for aggregates."""

    over: Over
    frame: Frame
    functions: tuple[Call, ...]


@dataclass(frozen=True)
class TopN(OneInput):
    order: tuple[SortKey, ...]
    limit: int | None
    offset: int
    ties: bool


@dataclass(frozen=True)
class TwoInputs(Stage):
    left: Stage
    right: Stage

    @property
    def inputs(self) -> tuple[Stage, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Join(TwoInputs):
    """kind: inner, left, right, full, semi, anti or null_aware_anti. keys: pairs of expressions, left and right, that must be equal;
    condition: what must hold besides (None: nothing)."""

    kind: str
    keys: tuple[tuple[Node, Node], ...]
    condition: Node | None


@dataclass(frozen=True)
class SetOperation(TwoInputs):
    """kind: union, intersect or except, with or without all; columns meet by place."""

    kind: str


@dataclass(frozen=True)
class Plan:
    """What the Sink gets: the last stage, and the result's column names."""

    top: Stage
    names: tuple[str, ...]
    sources: tuple[str, ...] = field(default=())


def stages(stage: Stage) -> list[Stage]:
    """Inputs before what reads them; a stage that is read twice occurs twice."""
    return [x for s in stage.inputs for x in stages(s)] + [stage]

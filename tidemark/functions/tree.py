"""Syntax tree of expressions and queries. All nodes are immutable and compare by value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass, replace


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    """Text of a literal as Spark reads it: a number, a quoted string, TRUE, NULL, DATE '...'."""

    text: str


@dataclass(frozen=True)
class Column(Node):
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Slot(Node):
    """A column of a plan's relation."""

    name: str


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class SortKey(Node):
    expr: Node
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Bound(Node):
    """Of a frame: unbounded, current or offset; before is the side for the first and last."""

    kind: str
    before: bool = True
    offset: Node | None = None


@dataclass(frozen=True)
class Frame(Node):
    mode: str = "RANGE"
    start: Bound = Bound("unbounded")
    end: Bound = Bound("current")
    exclude: str = "NO OTHERS"


@dataclass(frozen=True)
class Over(Node):
    partition: tuple[Node, ...] = ()
    order: tuple[SortKey, ...] = ()
    frame: Frame | None = None
    base: str | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    distinct: bool = False
    order: tuple[SortKey, ...] = ()
    where: Node | None = None
    over: Over | None = None
    ignore_nulls: bool = False


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class Is(Node):
    """IS [NOT] NULL, TRUE, FALSE or UNKNOWN."""

    x: Node
    what: str
    negated: bool


@dataclass(frozen=True)
class Between(Node):
    x: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class InList(Node):
    x: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class Like(Node):
    x: Node
    pattern: Node
    negated: bool
    kind: str = "LIKE"


@dataclass(frozen=True)
class Quantified(Node):
    """x op ANY|ALL (array)."""

    x: Node
    op: str
    every: bool
    array: Node


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Cast(Node):
    x: Node
    kind: str


@dataclass(frozen=True)
class Extract(Node):
    field: str
    x: Node


@dataclass(frozen=True)
class Row(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Exists(Node):
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Node):
    x: Node
    query: Query
    negated: bool


@dataclass(frozen=True)
class Table(Node):
    name: str
    alias: str


@dataclass(frozen=True)
class Derived(Node):
    query: Query
    alias: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class JoinItem(Node):
    kind: str
    left: Node
    right: Node
    on: Node | None = None
    using: tuple[str, ...] | None = None
    natural: bool = False


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    name: str | None


@dataclass(frozen=True)
class Query(Node):
    """SELECT, or with ``operation`` two queries combined; order, limit and offset are of the whole."""

    items: tuple[Node, ...] = ()
    sources: tuple[Node, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    grouped: bool = False
    having: Node | None = None
    windows: tuple[tuple[str, Over], ...] = ()
    distinct: bool = False
    order: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int = 0
    ties: bool = False
    operation: str | None = None
    left: Query | None = None
    right: Query | None = None


def children(node: object) -> list[Node]:
    """Nodes right below, not into subqueries."""
    found: list[Node] = []

    def add(x: object) -> None:
        if isinstance(x, Query):
            return
        if isinstance(x, Node):
            found.append(x)
        elif isinstance(x, tuple):
            for y in x:
                add(y)

    if is_dataclass(node):
        for f in fields(node):
            add(getattr(node, f.name))
    return found


def walk(node: Node):
    yield node
    for x in children(node):
        yield from walk(x)


def rewrite(node, change: Callable[[Node], Node | None]):
    """A copy with each node that change gives something for replaced, from the top; subqueries stay."""
    if isinstance(node, Query):
        return node
    if isinstance(node, tuple):
        return tuple(rewrite(x, change) for x in node)
    if not isinstance(node, Node):
        return node
    new = change(node)
    if new is not None:
        return new
    return replace(node, **{f.name: rewrite(getattr(node, f.name), change) for f in fields(node)})


def conjuncts(node: Node | None) -> list[Node]:
    if node is None:
        return []
    if isinstance(node, Binary) and node.op == "AND":
        return conjuncts(node.a) + conjuncts(node.b)
    return [node]

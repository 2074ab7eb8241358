"""A graph query as data, and its JSON form."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass
from typing import Any


class QueryError(ValueError):
    """A query that is refused."""


class ParseError(QueryError):
    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} (at {offset})")
        self.offset = offset


class PlanError(QueryError):
    """The text is well formed but means nothing over this graph."""


class CeilingError(QueryError):
    """A bound would be passed; nothing is cut off in silence."""


@dataclass(frozen=True)
class Node:
    var: str | None = None
    kinds: tuple = ()
    props: tuple = ()  # (name, value)


@dataclass(frozen=True)
class Rel:
    types: tuple = ()
    direction: str = "out"  # out, in, both
    hops: tuple | None = None  # (least, most)
    grade: str | None = None


@dataclass(frozen=True)
class Pattern:
    nodes: tuple
    rels: tuple = ()


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Listing:
    items: tuple


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any = None  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Neg:
    arg: Any


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple  # (condition or value, result)
    default: Any = None


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    args: tuple


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Cmp:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool = False


@dataclass(frozen=True)
class HasLabel:
    var: str
    kinds: tuple


@dataclass(frozen=True)
class Exists:
    pattern: Pattern


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Output:
    """What RETURN and WITH have in common."""

    items: tuple
    distinct: bool = False
    order: tuple = ()  # (expression, descending)
    skip: int | None = None
    limit: int | None = None
    where: Any = None


@dataclass(frozen=True)
class With:
    output: Output


@dataclass(frozen=True)
class Unwind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Query:
    pattern: Pattern | None
    where: Any
    stages: tuple
    output: Output
    union: Any = None  # (all, Query)


TYPES = {c.__name__: c for c in list(globals().values()) if isinstance(c, type) and is_dataclass(c)}


def to_json(x):
    if is_dataclass(x):
        return {"type": type(x).__name__} | {f.name: to_json(getattr(x, f.name)) for f in fields(x)}
    return [to_json(y) for y in x] if isinstance(x, tuple) else x


def from_json(x):
    """The query behind its JSON form; unknown types or fields are plan errors."""
    if isinstance(x, list):
        return tuple(map(from_json, x))
    if not isinstance(x, dict):
        return x
    rest = dict(x)
    kind = TYPES.get(rest.pop("type", None))
    if kind is None or not set(rest) <= {f.name for f in fields(kind)}:
        raise PlanError(f"not a query node: {x!r:.80}")
    return kind(**{k: from_json(v) for k, v in rest.items()})


def walk(x):
    """Every node below x, x first."""
    if isinstance(x, tuple):
        for y in x:
            yield from walk(y)
    elif is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))

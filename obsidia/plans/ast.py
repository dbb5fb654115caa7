"""Syntax tree of PromQL."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Expr:
    """Any expression."""


@dataclass
class Number(Expr):
    value: float


@dataclass
class String(Expr):
    value: str


@dataclass
class Matcher:
    name: str
    op: str
    value: str


@dataclass
class Selector(Expr):
    """``range_ns`` is None for an instant selector; ``at`` is nanoseconds, ``start`` or ``end``."""

    matchers: list[Matcher] = field(default_factory=list)
    range_ns: int | None = None
    offset_ns: int = 0
    at: int | str | None = None


@dataclass
class Subquery(Expr):
    expr: Expr
    range_ns: int
    step_ns: int | None
    offset_ns: int = 0
    at: int | str | None = None


@dataclass
class Unary(Expr):
    op: str
    expr: Expr


@dataclass
class Matching:
    on: bool = False
    labels: list[str] = field(default_factory=list)
    group: str | None = None
    include: list[str] = field(default_factory=list)


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    bool_: bool = False
    matching: Matching | None = None


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]


@dataclass
class Aggregate(Expr):
    """``by`` is None without a grouping clause."""

    op: str
    expr: Expr
    param: Expr | None = None
    by: bool | None = None
    labels: list[str] = field(default_factory=list)

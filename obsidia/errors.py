"""Typed errors of the query surfaces."""

from __future__ import annotations


class ObsidiaError(Exception):
    """Root of all errors of this package."""


class PromqlError(ObsidiaError):
    """Root of PromQL errors."""


class Parse(PromqlError):
    """The query text is malformed."""


class Unsupported(PromqlError):
    """The construct is recognised and rejected."""


class NonPositiveStep(PromqlError):
    """A range query's step must be positive."""


class InvalidRange(PromqlError):
    """End before start, or a range that is not positive."""


class TooManyPoints(PromqlError):
    """More steps than a range query may have."""


class EvalBudgetExhausted(PromqlError):
    """Subqueries evaluate too many points in all."""


class WrongType(PromqlError):
    """An expression has another type than its place asks for."""


class InvalidLabelName(PromqlError):
    """A label name is malformed."""


class InvalidRegex(PromqlError):
    """A matcher's pattern does not compile."""


class AmbiguousMatch(PromqlError):
    """Vector matching found several series where one is allowed."""


class SqlError(ObsidiaError):
    """Root of SQL errors."""


class Empty(SqlError):
    """No statement."""


class MultipleStatements(SqlError):
    """More than one statement."""


class SqlParse(SqlError):
    """The statement does not parse."""


class NotReadOnly(SqlError):
    """Only a query is admitted."""


class WriteInQuery(SqlError):
    """A write is nested in a query."""


class ExcludedAggregate(SqlError):
    """The aggregate is not admitted."""


class ExcludedScalar(SqlError):
    """The scalar function is not admitted."""


class ExcludedWindow(SqlError):
    """The window function is not admitted."""


class CrossSignalQuery(SqlError):
    """A query reads more than one signal table."""


class AnalyticsError(ObsidiaError):
    """Root of analytics errors."""


class SeriesTooLong(AnalyticsError):
    """A series has more points than change-point detection takes without downsampling."""


class EmptySeries(AnalyticsError):
    """A series has no usable point."""


class InvalidPercentile(AnalyticsError):
    """A percentile lies outside 0 to 100."""


class AlertingError(ObsidiaError):
    """A rule is malformed."""

"""Exceptions of the language, raised on the driver by name or in a plan by raise_error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class LanguageError(Exception):
    """Base of the language's exceptions."""


def _kind(name: str) -> type[LanguageError]:
    return type(name, (LanguageError,), {})


NAMES = ("Bind", "Chr", "Constraint", "Date", "Div", "Domain", "Empty", "Error", "Fail", "Match", "Option", "Overflow", "Size", "Span", "Subscript", "Time", "UnequalLengths", "Unordered")
Bind, Chr, Constraint, Date, Div, Domain, Empty, Error, Fail, Match, Option, Overflow, Size, Span, Subscript, Time, UnequalLengths, Unordered = map(_kind, NAMES)


def fail(name: str) -> Column:
    """An expression that fails with the exception's name wherever it is evaluated."""
    return F.raise_error(F.lit(name))


def guarded(ok: Column, value: Column, name: str) -> Column:
    """value where ok holds; elsewhere the exception."""
    return F.when(ok, value).otherwise(fail(name))

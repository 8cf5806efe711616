"""Expressions written as SQL text.

A Column of some thousand parts takes seconds to build, as each part is a call of the driver's JVM; written as text, it is one. The
functions here make text where pyspark.sql.functions makes Columns, under the same names, so that rules read the same. A rule made
callable by @written takes Columns from outside, is written out once for each choice of its options, and is parsed as a lambda over
its arguments; called by another rule, it becomes part of that rule's text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import functions as F

_depth = 0


def _sql(x) -> str:
    return x.sql if isinstance(x, Written) else lit(x).sql


class Written:
    """The text of an expression, with a Column's operators."""

    def __init__(self, sql: str):
        self.sql = sql

    def _with(self, operator: str, other, swapped: bool = False) -> Written:
        a, b = (_sql(other), self.sql) if swapped else (self.sql, _sql(other))
        return Written(f"({a} {operator} {b})")

    __eq__ = lambda self, o: self._with("=", o)
    __ne__ = lambda self, o: self._with("<>", o)
    __lt__ = lambda self, o: self._with("<", o)
    __le__ = lambda self, o: self._with("<=", o)
    __gt__ = lambda self, o: self._with(">", o)
    __ge__ = lambda self, o: self._with(">=", o)
    __add__ = lambda self, o: self._with("+", o)
    __sub__ = lambda self, o: self._with("-", o)
    __and__ = lambda self, o: self._with("AND", o)
    __or__ = lambda self, o: self._with("OR", o)
    __hash__ = None

    def __invert__(self) -> Written:
        return Written(f"(NOT {self.sql})")

    def __getitem__(self, key: str | int) -> Written:
        return Written(f"{self.sql}[{_sql(key)}]")

    def alias(self, name: str) -> tuple[str, Written]:
        """For struct()."""
        return name, self

    def cast(self, kind: str) -> Written:
        return Written(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Written:
        return Written(f"TRY_CAST({self.sql} AS {kind})")

    def isNull(self) -> Written:  # noqa: N802
        return Written(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Written:  # noqa: N802
        return Written(f"({self.sql} IS NOT NULL)")

    def __getattr__(self, name: str) -> Callable[..., Written]:
        """contains(), rlike() and other methods that are functions too."""
        if name.startswith("_"):
            raise AttributeError(name)
        return functools.partial(_call, name, self)


class Case(Written):
    """CASE, whose branches come one by one."""

    def __init__(self, branches: str):
        super().__init__(f"(CASE{branches} END)")
        self.branches = branches

    def when(self, condition, value) -> Case:
        return Case(f"{self.branches} WHEN {_sql(condition)} THEN {_sql(value)}")

    def otherwise(self, value) -> Written:
        return Written(f"(CASE{self.branches} ELSE {_sql(value)} END)")


def when(condition, value) -> Case:
    return Case("").when(condition, value)


def lit(value) -> Written:
    if isinstance(value, str):
        return Written("'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'")
    if isinstance(value, float) and not math.isfinite(value):
        return Written(f"double('{value}')")
    return Written({None: "NULL", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else repr(value))


def struct(*fields: tuple[str, Written]) -> Written:
    return Written("named_struct(" + ", ".join(f"{_sql(n)}, {_sql(x)}" for n, x in fields) + ")")


def _lambda(use: Callable, arguments: int = 1) -> str:
    """A function in SQL; arguments are named by how deep it stands, and mean nothing outside."""
    global _depth
    names = [f"{letter}{_depth}" for letter in "xy"[:arguments]]
    _depth += 1
    try:
        named = names[0] if arguments == 1 else f"({', '.join(names)})"
        return f"{named} -> {_sql(use(*map(Written, names)))}"
    finally:
        _depth -= 1


def transform(array: Written, use: Callable) -> Written:
    return Written(f"transform({_sql(array)}, {_lambda(use)})")


def forall(array: Written, use: Callable) -> Written:
    return Written(f"forall({_sql(array)}, {_lambda(use)})")


def aggregate(array: Written, zero: Written, merge: Callable, finish: Callable | None = None) -> Written:
    return Written(f"aggregate({_sql(array)}, {_sql(zero)}, {_lambda(merge, 2)}{', ' + _lambda(finish) if finish else ''})")


def _call(name: str, *arguments) -> Written:
    return Written(f"{name}({', '.join(map(_sql, arguments))})")


def __getattr__(name: str) -> Callable[..., Written]:
    """Any other function of SQL."""
    if name.startswith("__"):
        raise AttributeError(name)
    return functools.partial(_call, name)


def of(x):
    """The module that makes what x is: text, or Columns."""
    import sys

    return sys.modules[__name__] if isinstance(x, Written) else F


def let(value, use: Callable):
    """use(value), with value computed once and written once in the plan."""
    f = of(value)
    return f.transform(f.array(value), use)[0]


def written(columns: int) -> Callable:
    """Makes a rule of so many columns, and options behind them, callable with Columns."""

    def decorated(rule: Callable) -> Callable:
        @functools.cache
        def text(rest: tuple, options: tuple) -> str:
            v = Written("v")
            return f"v -> {rule(*([v] if columns == 1 else [v[f'c{i}'] for i in range(columns)]), *rest, **dict(options)).sql}"

        @functools.wraps(rule)
        def call(*arguments, **options):
            given = arguments[:columns]
            if isinstance(given[0], Written):
                return rule(*arguments, **options)
            value = given[0] if columns == 1 else F.struct(*(c.alias(f"c{i}") for i, c in enumerate(given)))
            return F.call_function("transform", F.array(value), F.expr(text(arguments[columns:], tuple(sorted(options.items())))))[0]

        call.text = text
        return call

    return decorated


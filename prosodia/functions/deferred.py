"""Arrow functions whose types are parsed on first use.

A DDL type needs a running session to be parsed; modules are also imported by Python workers, which
have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf(ddl)``, without a session at import."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(f, ddl)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap


def array_function(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """The same for a function of Arrow arrays (``arrow_udf``): rows become Python objects only where it makes them so."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.arrow_udf(f, ddl)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap

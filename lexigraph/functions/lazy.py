"""User-defined functions that are made when first called, since their types need a running session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column


def column_function(kind: Callable, returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(function: Callable) -> Callable[..., Column]:
        made: list = []

        def call(*columns) -> Column:
            if not made:
                made.append(kind(function, returns))
            return made[0](*columns)

        call.__doc__ = function.__doc__
        return call

    return wrap

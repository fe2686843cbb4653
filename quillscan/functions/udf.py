"""Vectorised Python functions whose types are only parsed where a session uses them, not where a worker imports them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F


def vectorized(ddl: str) -> Callable:
    def mark(function: Callable) -> Callable:
        @wraps(function)
        def call(*columns):
            return F.pandas_udf(function, ddl)(*columns)

        return call

    return mark

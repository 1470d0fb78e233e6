"""Columns that are built once and used again within one Spark application."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import SparkSession


def remembered(build: Callable) -> Callable:
    """Keep what ``build`` returns for the same arguments, as long as the application lives.

    A column holds objects of the application that made it.  Another application, such as one
    that was started after the first was stopped, gets columns of its own.
    """

    @lru_cache(maxsize=16)
    def for_application(application: str, *args, **named):
        return build(*args, **named)

    @wraps(build)
    def of(*args, **named):
        return for_application(SparkSession.active().sparkContext.applicationId, *args, **named)

    return of

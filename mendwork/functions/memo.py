"""Column expressions that are built once.

Building a large expression costs many calls into the JVM; one that depends
only on column names and plain values can be used again in any plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def memo(build: Callable) -> Callable:
    """Cache ``build`` by its (hashable) arguments and the JVM that holds the result."""
    made: dict = {}

    @wraps(build)
    def cached(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return cached

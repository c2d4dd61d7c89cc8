"""Reuse of column expressions that are the same in every query."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext


def once(build):
    """Build an argument-free expression once per JVM.

    Columns are only descriptions until a query resolves them, but the long ones take
    thousands of calls to the JVM to write down, which every micro-batch would repeat.
    """
    kept: dict[int, object] = {}

    @wraps(build)
    def reused():
        gateway = id(SparkContext._gateway)
        if gateway not in kept:
            kept.clear()
            kept[gateway] = build()
        return kept[gateway]

    return reused

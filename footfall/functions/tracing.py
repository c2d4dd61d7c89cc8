"""Trace, span and sampling flag of a request from its trace headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import none_if_empty


def _piece(parts: Column, index: int) -> Column:
    return none_if_empty(F.get(parts, F.lit(index)))


def trace_context(cloud: Column, traceparent: Column, project: str | None) -> dict[str, Column]:
    """``trace``, ``span_id`` and ``sampled``; all NULL without a project.

    The cloud header (``TRACE/SPAN;o=FLAG``) counts first. The W3C header is read
    only where the cloud header gave no trace, and then replaces span and flag.
    """
    if not project:
        nothing = F.lit(None)
        return {
            "trace": nothing.cast("string"),
            "span_id": nothing.cast("string"),
            "sampled": nothing.cast("boolean"),
        }

    def path(trace: Column) -> Column:
        return F.concat(F.lit(f"projects/{project}/traces/"), trace)

    sides = F.split(cloud, "/")
    tail = F.split(_piece(sides, 1), ";o=")
    own_trace = _piece(sides, 0)
    own_flag = _piece(tail, 1)

    w3c = F.split(traceparent, "-")
    usable = own_trace.isNull() & (F.get(w3c, F.lit(0)) == "00") & _piece(w3c, 1).isNotNull()
    # Only the last hex digit decides whether bit 0 is set.
    flags = F.regexp_extract(F.coalesce(F.get(w3c, F.lit(3)), F.lit("")), r"\A\s*([0-9a-fA-F]+)", 1)
    odd = flags.rlike("[13579bdfBDF]\\z")

    return {
        "trace": F.when(usable, path(_piece(w3c, 1))).otherwise(path(own_trace)),
        "span_id": F.when(usable, F.get(w3c, F.lit(2))).otherwise(F.get(tail, F.lit(0))),
        "sampled": F.when(usable, odd).otherwise(own_flag == "1"),
    }

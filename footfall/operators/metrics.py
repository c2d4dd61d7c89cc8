"""In-flight counts (M1) on rows whose verdict is expensive to work out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(
    df: DataFrame, conditions: dict[str, Column], observation: Observation | str | None = None
) -> DataFrame:
    """Count rows per condition while they pass by.

    The counts go to ``observation``, or under that name to query listeners and, in a
    stream, to its progress. Counting also settles
    where the verdict is computed: a later filter on it cannot be pushed below the
    count, where Catalyst would have to repeat the whole validation inside the filter.
    """
    sums = [F.count_if(holds).alias(name) for name, holds in conditions.items()]
    return df.observe(observation or f"footfall-{uuid.uuid4().hex}", *sums)

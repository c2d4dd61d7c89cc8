"""Written intermediate tables, and batches of texts inside tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import workspace


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines do not share that folder, install the package on them.
    """
    root, known = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))
    return spark


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs the reading of files, never a second run
    of what made them, and rows that depend on task order stay as they were written.
    """
    spark = df.sparkSession
    path = workspace(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` from one that ``make`` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return run


def partitions(spark: SparkSession) -> int:
    """How many partitions the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

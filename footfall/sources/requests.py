"""Captured page-hit requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REQUESTS


def read_requests(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    streaming: bool = False,
    lower_case_headers: bool = False,
) -> DataFrame:
    """Requests from Parquet or JSON lines, as a table or as a stream.

    The schema is given, so nothing is inferred and unknown columns are not read.
    Header names are expected in lower case, as servers hand them on; set
    ``lower_case_headers`` for captures that kept the client's spelling.
    """
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(REQUESTS).format(file_format).load(path)
    if lower_case_headers:
        lowered = F.transform_keys("http_headers", lambda name, _: F.lower(name))
        df = df.withColumn("http_headers", lowered)
    return df

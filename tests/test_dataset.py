"""Derived requests and topics are dealt over tasks by their number of rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import dataset, queries

ROWS = 9_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with one file of events in one row group, as small tables come."""
    folder = str(tmp_path_factory.mktemp("events"))
    spark.range(0, ROWS, 1, 1).select(
        F.col("id").alias("event_id"),
        F.lit(datetime(2024, 1, 1, 12)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 97).alias("user_id"),
        F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    return folder


def _rows_by_task(df):
    return [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]


def test_tasks_grow_with_the_rows():
    assert dataset.tasks_for(0, 12) == 1
    assert dataset.tasks_for(10_000, 12) == 5
    assert dataset.tasks_for(100_000, 12) == 24
    assert dataset.tasks_for(36_000_000, 12) == 36_000_000 // dataset.TASK_ROWS


def test_events_of_one_file_are_derived_by_several_tasks(spark, events):
    rows = _rows_by_task(dataset.derive_requests(spark, events))
    assert sum(rows) == ROWS and len(rows) > 1 and max(rows) < ROWS / 2


def test_few_requests_are_checked_by_several_tasks(spark, events):
    """Files of a stored table are not packed into one split because they are small."""
    rows = _rows_by_task(dataset.requests(spark, events))
    assert sum(rows) == ROWS and len(rows) > 1


def test_batches_of_a_stream_keep_all_cores_busy(spark, events, monkeypatch):
    monkeypatch.setattr(dataset, "TASK_ROWS", 100)
    dataset._TABLES.clear()
    batches = []
    query = dataset.request_stream(spark, events).writeStream.foreachBatch(
        lambda batch, _: batches.append(batch.count())
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    dataset._TABLES.clear()
    # 90 files, 16 at a time for 4 cores; 4 at a time would be 23 batches.
    assert sum(batches) == ROWS and len(batches) == 6


def test_topic_has_more_files_for_more_messages(spark, events, folder, monkeypatch):
    monkeypatch.setattr(dataset, "TASK_ROWS", 500)
    stream = queries._topic(spark, events, folder, batches=2)
    sizes = []
    query = stream.writeStream.foreachBatch(
        lambda batch, _: sizes.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sizes) == 2
    assert sum(rows for rows, _ in sizes) == queries._messages(spark, events).count()
    assert all(files > 3 for _, files in sizes)

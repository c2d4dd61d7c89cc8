"""The streaming worker: same result as batch, replays, drains, empty batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from footfall.operators import enrich, rawcheck, salts
from footfall.sources import events as sinks
from footfall.sources import topic
from footfall.sources.salt_store import SaltStore
from footfall.streaming import worker
from samples import RAW, changed

BOT = "curl/7.68.0"


def messages(count=60):
    rows = []
    for i in range(count):
        event = changed(RAW, "payload.event_id", f"event-{i}")
        event = changed(event, "site_uuid", f"12345678-1234-1234-1234-12345678901{i % 3}")
        event = changed(event, "meta.ip", f"10.0.0.{i % 7}")
        if i % 10 == 0:
            event = changed(event, "meta.user-agent", BOT)
        rows.append((json.dumps(event) if i % 15 != 1 else "broken",))
    return rows


def publish(spark, path, rows, files=3):
    df = spark.createDataFrame(rows, "value string").withColumn("published_at", F.current_timestamp())
    df.repartition(files).write.mode("append").parquet(path)


def start(spark, folder, store, **options):
    stream = topic.read_raw_stream(spark, f"{folder}/topic", files_per_trigger=1)
    query = worker.start_worker(
        stream, f"{folder}/out", f"{folder}/checkpoint", store, enrich.known_domains(spark),
        drain=True, salt_day="event", **options,
    )
    query.awaitTermination()


def lines(spark, folder):
    return sorted(row["value"] for row in sinks.read_events_ndjson(spark, f"{folder}/out/events").collect())


@pytest.fixture(scope="module")
def drained(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("worker"))
    store = SaltStore(spark, f"{folder}/salts")
    publish(spark, f"{folder}/topic", messages())
    start(spark, folder, store, batch_size=5)
    return folder, store


def test_stream_equals_batch(spark, drained):
    folder, store = drained
    checked = rawcheck.validate_raw(topic.read_raw(spark, f"{folder}/topic").select("value"))
    batch = enrich.enrich(rawcheck.valid_events(checked), store.load(), enrich.known_domains(spark))
    expected = sorted(row["value"] for row in topic.as_json(batch).collect())
    assert lines(spark, folder) == expected and len(expected) == 60 - 6 - 4
    events = [json.loads(line) for line in expected]
    assert all(len(e["session_id"]) == 64 and "meta" not in e for e in events)
    assert not any("10.0.0." in line for line in expected)


def test_counts_and_dead_letters(spark, drained):
    folder, _ = drained
    counts = spark.read.json(f"{folder}/out/counts").agg(
        *[F.sum(name).alias(name) for name in ("messages", "parse_failures", "bots", "events")]
    ).first()
    assert counts.asDict() == {"messages": 60, "parse_failures": 4, "bots": 6, "events": 50}
    dead = spark.read.json(f"{folder}/out/dead").select("value", "error").collect()
    assert {tuple(row) for row in dead} == {("broken", "invalid JSON")} and len(dead) == 4


def test_files_hold_at_most_a_batch(spark, drained):
    folder, _ = drained
    for root, _, files in os.walk(f"{folder}/out/events"):
        for name in files:
            if name.endswith(".txt"):
                with open(f"{root}/{name}") as file:
                    assert len(file.readlines()) <= 5


def test_restart_continues_after_the_checkpoint(spark, drained):
    folder, store = drained
    before = lines(spark, folder)
    start(spark, folder, store)
    assert lines(spark, folder) == before
    salts_before = store.load().count()
    publish(spark, f"{folder}/topic", [(json.dumps(changed(RAW, "payload.event_id", "later")),)], 1)
    start(spark, folder, store)
    assert len(lines(spark, folder)) == len(before) + 1
    assert store.load().count() == salts_before
    assert store.load().select("key").distinct().count() == salts_before


def test_replayed_batch_replaces_its_output(spark, folder):
    store = SaltStore(spark, f"{folder}/salts")
    df = spark.createDataFrame(messages(20), "value string")
    day = enrich.event_day(F.col("timestamp"))
    # First attempt: salts are stored, then the job dies before it writes events.
    checked = rawcheck.validate_raw(df)
    store.get_or_create(salts.wanted_keys(rawcheck.valid_events(checked), day))
    attempts = []
    for _ in range(2):
        worker.process_batch(df, 3, f"{folder}/out", store, enrich.known_domains(spark), day)
        attempts.append(lines(spark, folder))
    assert len(attempts[0]) == 16 and attempts[0] == attempts[1]
    assert os.listdir(f"{folder}/out/events/run=batch") == ["batch_id=3"]
    assert store.load().groupBy("key").count().filter("count > 1").count() == 0


def test_batch_without_events_writes_none(spark, folder):
    store = SaltStore(spark, f"{folder}/salts")
    only_bots = [(json.dumps(changed(RAW, "meta.user-agent", BOT)),)]
    df = spark.createDataFrame(only_bots, "value string")
    worker.process_batch(
        df, 0, f"{folder}/out", store, enrich.known_domains(spark), enrich.event_day(F.col("timestamp"))
    )
    assert sorted(os.listdir(f"{folder}/out")) == ["counts"]


def test_empty_batch_is_not_written(spark, folder):
    empty = spark.createDataFrame([], "a string")
    assert sinks.write_events_ndjson(empty, folder) is False and not os.path.exists(folder)


def test_another_checkpoint_overwrites_nothing(spark, folder):
    store = SaltStore(spark, f"{folder}/salts")
    for number in range(2):
        topic_path = f"{folder}/topic{number}"
        publish(spark, topic_path, [(json.dumps(changed(RAW, "payload.event_id", f"e{number}")),)], 1)
        worker.start_worker(
            topic.read_raw_stream(spark, topic_path), f"{folder}/out", f"{folder}/checkpoint{number}",
            store, enrich.known_domains(spark), drain=True, salt_day="event",
        ).awaitTermination()
    assert len(lines(spark, folder)) == 2


def test_default_writes_one_large_file(spark, folder):
    store = SaltStore(spark, f"{folder}/salts")
    publish(spark, f"{folder}/topic", messages(300), 1)
    start(spark, folder, store)
    files = [name for _, _, names in os.walk(f"{folder}/out/events") for name in names if name.endswith(".txt")]
    assert len(files) == 1 and len(lines(spark, folder)) > 50


def test_worker_survives_cleanup_between_batches(spark, folder):
    store = SaltStore(spark, f"{folder}/salts")
    old = salts.salt_rows(
        spark.createDataFrame([("salt:2020-01-01:s",)], "key string"), F.lit("0" * 64), F.timestamp_seconds(F.lit(1577836800))
    )
    store.append(old)
    publish(spark, f"{folder}/topic", messages(), 3)
    start(spark, folder, store, cleanup=True)
    assert len(lines(spark, folder)) == 50
    assert store.load().filter("salt_date < '2021-01-01'").count() == 0
    assert len(store._all_versions()) == 1


def test_published_stream_equals_the_published_table(spark, folder):
    from footfall.plans import modes
    from samples import request

    columns = "method string, url string, http_headers map<string,string>, remote_ip string, received_at timestamp, body string"
    spark.createDataFrame([request()], columns).write.parquet(f"{folder}/requests")
    stream = spark.readStream.schema(columns).parquet(f"{folder}/requests")
    topic.publish_raw_stream(modes.admit(stream), f"{folder}/a", f"{folder}/ca", drain=True).awaitTermination()
    topic.publish_raw(modes.admit(spark.read.parquet(f"{folder}/requests")), f"{folder}/b")
    found = [[r["value"] for r in topic.read_raw(spark, f"{folder}/{x}").collect()] for x in "ab"]
    assert found[0] == found[1] and len(found[0]) == 1
    known = store_of(spark, folder).load()
    inline = modes.process_inline(stream, known, enrich.known_domains(spark))
    assert inline.isStreaming


def store_of(spark, folder):
    return SaltStore(spark, f"{folder}/no-salts")

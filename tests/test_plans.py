"""Shapes of the physical plans that large inputs depend on."""

import json
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from footfall.config import Settings
from footfall.operators import admission, enrich, hits, rawcheck, salts
from footfall.plans import modes
from footfall.sources import topic
from samples import BODY, GONE, HEADERS, RAW, changed, frame, request

MIXED = [
    request(),
    request(changed(BODY, "payload.event_id", "kept")),
    request(changed(BODY, "action", "click")),
    request(headers={**HEADERS, "user-agent": "curl/7.68.0"}),
    request("{"),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def known(spark):
    keys = spark.createDataFrame([("salt:2025-04-14:940b73e9-4952-4752-b23d-9486f999c47e",)], "key string")
    return salts.salt_rows(keys, F.lit("s" * 64), F.lit("2025-04-14").cast("timestamp"))


def test_admission_needs_no_shuffle_and_no_python(spark, tmp_path):
    frame(spark, MIXED).write.parquet(str(tmp_path / "requests"))
    requests = spark.read.parquet(str(tmp_path / "requests"))
    raw = hits.to_raw(admission.classify_requests(requests, Settings(hmac_secret="s")))
    text = plan(raw)
    for word in ("Exchange hash", "Python", "CartesianProduct", "NestedLoop"):
        assert word not in text


def test_enrichment_broadcasts_small_tables_only(spark, known, tmp_path):
    modes.admit(frame(spark, MIXED)).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    text = plan(enrich.enrich(raw, known, enrich.known_domains(spark)))
    assert text.count("BroadcastHashJoin") == 2
    for word in ("Exchange hash", "Python", "CartesianProduct", "NestedLoop"):
        assert word not in text
    # Unused members of the raw events are not read.
    narrow = plan(enrich.attach_signature(raw, known, enrich.event_day(F.col("timestamp"))).select("session_id"))
    scan = next(line for line in narrow.splitlines() if "ReadSchema" in line)
    assert "site_uuid" in scan and "href" not in scan


def _planned(df):
    """The physical plan and the seconds that it took to make it."""
    start = time.perf_counter()
    return plan(df), time.perf_counter() - start


def test_request_to_event_is_one_job(spark, known, tmp_path):
    frame(spark, MIXED).write.parquet(str(tmp_path / "requests"))
    requests = spark.read.parquet(str(tmp_path / "requests"))
    domains = enrich.known_domains(spark)
    text, seconds = _planned(modes.traffic(modes.process_inline(requests, known, domains, Settings(hmac_secret="s"))))
    # The requests are read once, and only the report's own aggregate shuffles.
    assert seconds < 5 and text.count("FileScan parquet") == 1
    assert "Python" not in text and "Exchange hashpartitioning(site_uuid" in text
    assert all("site_uuid" in line for line in text.splitlines() if "Exchange hashpartitioning" in line)


def test_validation_and_enrichment_are_one_job(spark, known, tmp_path):
    messages = topic.to_messages(modes.admit(frame(spark, MIXED)))
    messages.write.parquet(str(tmp_path / "topic"))
    events = rawcheck.valid_events(rawcheck.validate_raw(topic.read_raw(spark, str(tmp_path / "topic"))))
    for df in (
        enrich.enrich(events, known, enrich.known_domains(spark)),
        salts.wanted_keys(events, enrich.event_day(F.col("timestamp"))),
    ):
        text, seconds = _planned(df)
        assert seconds < 5 and text.count("FileScan parquet") == 1


def test_outcomes_are_observed_on_the_way(spark):
    counts = Observation("requests")
    df = admission.classify_requests(frame(spark, MIXED), observation=counts)
    assert len(df.collect()) == 5
    assert counts.get == {"accepted": 2, "bot": 1, "rejected": 2, "not_found": 0}


def test_inline_and_queued_way_agree(spark, known, tmp_path):
    requests = frame(spark, MIXED)
    domains = enrich.known_domains(spark)
    seed = F.sha2("body", 256)
    inline = modes.process_inline(requests, known, domains, event_id_seed=seed)
    queued = modes.process_in_two_steps(
        requests, known, domains, str(tmp_path / "topic"), event_id_seed=seed
    )
    assert inline.schema.simpleString() == queued.schema.simpleString()
    found = sorted(row["value"] for row in topic.as_json(inline).collect())
    assert found == sorted(row["value"] for row in topic.as_json(queued).collect())
    assert len(found) == 2 and all('"session_id":"' in value for value in found)


def test_made_event_ids_derive_from_the_request(spark):
    raw = modes.admit(frame(spark, MIXED * 10))
    ids = sorted(row[0] for row in raw.select("payload.event_id").collect())
    assert ids == sorted(row[0] for row in raw.select("payload.event_id").collect())
    assert len(set(ids) - {"kept"}) == 1  # the requests agree in everything


def test_missing_event_id_is_replaced_and_empty_one_kept(spark, known):
    texts = [json.dumps(changed(RAW, "payload.event_id", value)) for value in ("", GONE)]
    df = spark.createDataFrame([(text,) for text in texts], "value string")
    events = rawcheck.valid_events(rawcheck.validate_raw(df))
    done = enrich.to_processed(events, known, enrich.known_domains(spark)).collect()
    ids = sorted(row["payload"]["event_id"] for row in done)
    assert ids[0] == "" and len(ids[1]) == 36

"""The admission worker: four outputs from one pass, restarts, replays, counts."""

import json
import os
import shutil

from pyspark.sql import functions as F

from footfall.operators import admission, hits, reports
from footfall.plans import modes
from footfall.schemas import REQUESTS
from footfall.sources import topic
from footfall.streaming import admission_worker as worker
from samples import BODY, HEADERS, changed, frame, request

MIXED = [
    request(),
    request(changed(BODY, "payload.event_id", "kept")),
    request(changed(BODY, "payload.utm_term", {})),
    request(headers={**HEADERS, "user-agent": "curl/7.68.0"}),
    request("{"),
    request(url="/elsewhere"),
]


def run(spark, folder, **options):
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/requests")
    query = worker.start_admission(stream, f"{folder}/out", f"{folder}/checkpoint", drain=True, **options)
    query.awaitTermination()
    return query


def written(spark, folder):
    return sorted((r["output"], r["value"]) for r in worker.read_outputs(spark, f"{folder}/out").collect())


def test_outputs_add_up_and_equal_the_batch_operators(spark, folder):
    requests = frame(spark, MIXED)
    requests.repartition(3).write.parquet(f"{folder}/requests")
    query = run(spark, folder)
    assert worker.outcome_totals(query) == {"accepted": 2, "bot": 1, "rejected": 2, "not_found": 1}
    found = written(spark, folder)
    assert [o for o, _ in found] == ["bots"] + ["log"] * 6 + ["raw"] * 2 + ["rejects"] * 2

    def values(output):
        return sorted(r["value"] for r in worker.read_output(spark, f"{folder}/out", output).collect())

    def documents(df):
        return sorted(r["value"] for r in topic.as_json(df).collect())

    assert values("raw") == documents(modes.admit(requests))
    assert values("rejects") == documents(reports.reject_records(admission.classify_requests(requests)))
    logged = [json.loads(v) for v in values("log")]
    assert sorted((v["outcome"], v["status"]) for v in logged) == [
        ("accepted", 202), ("accepted", 202), ("bot", 202), ("not_found", 404), ("rejected", 400), ("rejected", 400),
    ]


def test_a_replayed_batch_adds_nothing(spark, folder):
    frame(spark, MIXED).repartition(2).write.parquet(f"{folder}/requests")
    run(spark, folder)
    before = written(spark, folder)
    # The last batch was written, but the worker died before it noted so.
    commits = [n for n in os.listdir(f"{folder}/checkpoint/commits") if n.isdigit()]
    last = max(commits, key=int)
    shutil.move(f"{folder}/checkpoint/commits/{last}", f"{folder}/lost")
    shutil.move(f"{folder}/checkpoint/commits/.{last}.crc", f"{folder}/lost.crc")
    run(spark, folder)
    assert os.path.exists(f"{folder}/checkpoint/commits/{last}")
    assert written(spark, folder) == before


def test_a_restart_takes_only_new_requests(spark, folder):
    frame(spark, MIXED).write.parquet(f"{folder}/requests")
    run(spark, folder)
    frame(spark, [request(changed(BODY, "payload.event_id", "later"))]).write.mode("append").parquet(f"{folder}/requests")
    run(spark, folder)
    raw = worker.read_output(spark, f"{folder}/out", "raw")
    assert raw.count() == 3 and raw.filter(F.col("value").contains('"later"')).count() == 1


def test_outputs_are_a_stream_again(spark, folder):
    frame(spark, MIXED).write.parquet(f"{folder}/requests")
    run(spark, folder)
    stream = worker.read_output_stream(spark, f"{folder}/out")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c2")
        .trigger(availableNow=True).start(f"{folder}/copy")
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/copy").count() == 2


def test_one_pass_without_shuffle(spark, folder):
    frame(spark, MIXED).write.parquet(f"{folder}/requests")
    routed = worker.route(spark.read.schema(REQUESTS).parquet(f"{folder}/requests"))
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    for word in ("Exchange", "Python", "Join"):
        assert word not in plan


def test_no_requests_give_no_documents(spark):
    empty = spark.createDataFrame([], REQUESTS)
    assert worker.route(empty).count() == 0
    assert hits.to_raw(admission.classify_requests(empty)).count() == 0

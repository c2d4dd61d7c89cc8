"""Benchmark of the headline jobs; prints one JSON line.

Captured requests are derived from the events table and written before timing starts.
Each job reads its input from Parquet and is run to the end; the best of the timed
runs counts, after one run that warms up the JVM.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import dataset
from footfall.config import Settings
from footfall.operators import admission, enrich, rawcheck, reports, salts
from footfall.plans import modes
from footfall.session import prepare, workspace
from footfall.sources import events as sinks
from footfall.sources import topic
from footfall.sources.salt_store import SaltStore
from footfall.streaming import worker

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("footfall-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="footfall-bench-"))
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job, runs: int = RUNS) -> float:
    job()
    best = None
    for _ in range(runs):
        start = time.perf_counter()
        job()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    return round(best, 3)


def main() -> None:
    spark = session()

    def stored(name: str, df: DataFrame) -> DataFrame:
        path = workspace(spark, name)
        df.repartition(int(CPUS)).write.parquet(path)
        return spark.read.parquet(path)

    requests = stored("requests", dataset.derive_requests(spark, SF_DIR))
    signed = stored("signed", dataset.derive_signed(spark, SF_DIR))
    known = stored("salts", dataset.derive_salts(spark, SF_DIR))
    raw = stored("raw", modes.admit(requests))
    messages = stored("messages", topic.to_messages(raw))
    domains = enrich.known_domains(spark)
    day = enrich.event_day(F.col("timestamp"))
    rows = requests.count()

    def salt_job() -> None:
        store = SaltStore(spark, workspace(spark, "new-salts"))
        store.get_or_create(salts.wanted_keys(raw, day))

    def stream_job() -> None:
        root = workspace(spark, "stream")
        store = SaltStore(spark, f"{root}/salts")
        query = worker.start_worker(
            topic.read_raw_stream(spark, messages.inputFiles()[0].rsplit("/", 1)[0]),
            f"{root}/out", f"{root}/checkpoint", store, domains,
            batch_size=None, drain=True, salt_day="event",
        )
        query.awaitTermination()

    jobs = {
        "classify": lambda: run(admission.classify_requests(requests)),
        "admit_to_raw": lambda: run(modes.admit(requests)),
        "verify_signatures": lambda: run(
            admission.apply_hmac_policy(signed, Settings(hmac_secret=dataset.SIGNING_SECRET))
        ),
        "validate_messages": lambda: run(rawcheck.validate_raw(messages)),
        "enrich": lambda: run(enrich.enrich(raw, known, domains)),
        "write_ndjson": lambda: sinks.write_events_ndjson(
            enrich.enrich(raw, known, domains), workspace(spark, "ndjson")
        ),
        "create_salts": salt_job,
        "outcome_counts": lambda: run(reports.outcome_counts(admission.classify_requests(requests))),
        "traffic": lambda: run(modes.traffic(enrich.enrich(raw, known, domains))),
        "inline": lambda: run(modes.process_inline(requests, known, domains)),
        "stream_drain": stream_job,
    }
    seconds = {name: timed(job) for name, job in jobs.items()}
    print(
        json.dumps(
            {
                "metric": "page-hit jobs, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "requests": rows,
                "requests_per_sec": {name: round(rows / s) for name, s in seconds.items()},
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""The admission worker: captured requests to raw topic, rejects, bots and request log.

A micro-batch is classified once and written once, into one folder per output. The file
sink keeps a log of its batches: one that is replayed after a failure is not added twice,
and readers see no file of an attempt that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..config import Settings
from ..operators import admission, hits, reports
from ..plans.modes import request_seed
from ..schemas import TOPIC
from ..sources.topic import KEEP_NULLS

#: Name of the counts per outcome in the progress of the stream.
METRICS = "admission"


def route(
    requests: DataFrame, settings: Settings = Settings(), event_id_seed: Column | None = None
) -> DataFrame:
    """``value``, ``published_at`` and ``output``: what comes of each request, as JSON.

    ``log`` has a row for every request, with its outcome; ``raw`` the event of an accepted
    one, ``rejects`` the record of a rejected one and ``bots`` the log row of a bot's. The
    documents of a request are made from one verdict, so nothing is validated again.
    """
    seed = request_seed() if event_id_seed is None else event_id_seed
    verdicts = admission.classify_requests(requests.withColumn("_seed", seed), settings, METRICS)
    verdicts = verdicts.withColumn("_sent_at", hits.sent_at(settings))

    def document(output: str, columns: list[Column]) -> Column:
        value = F.to_json(F.struct(*columns), KEEP_NULLS)
        return F.struct(F.lit(output).alias("output"), value.alias("value"))

    logged = [*reports.log_columns(settings), F.col("outcome"), F.col("status")]
    outcome = F.col("outcome")
    documents = F.array(
        document("log", logged),
        F.when(outcome == "bot", document("bots", logged)),
        F.when(outcome == "rejected", document("rejects", reports.reject_columns())),
        F.when(
            outcome == "accepted",
            document("raw", hits.raw_columns(F.col("_sent_at"), F.col("_seed"))),
        ),
    )
    routed = verdicts.select(F.inline(F.array_compact(documents)))
    return routed.select("value", F.current_timestamp().alias("published_at"), "output")


def start_admission(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    settings: Settings = Settings(),
    event_id_seed: Column | None = None,
    flush_ms: int = rules.FLUSH_INTERVAL_MS,
    drain: bool = False,
) -> StreamingQuery:
    """Start the worker on a stream of requests; it writes below ``out``.

    ``drain`` works off what is there and stops. Rejects and bots hold addresses and whole
    bodies: keep access narrow.
    """
    routed = route(requests, settings, event_id_seed)
    writer = (
        routed.writeStream.format("parquet").partitionBy("output").outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if drain:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{flush_ms} milliseconds")
    return writer.start(out)


def outcome_totals(query: StreamingQuery) -> dict[str, int]:
    """M1: requests per outcome in the batches that the query's progress still shows.

    They are observed on the way, without a job of their own. No shuffle follows, so a
    task that runs again is counted once.
    """
    totals: dict[str, int] = {}
    for progress in query.recentProgress:
        counts = progress.observedMetrics.get(METRICS)
        for name, number in (counts.asDict() if counts else {}).items():
            totals[name] = totals.get(name, 0) + number
    return totals


_WRITTEN = T.StructType([*TOPIC.fields, T.StructField("output", T.StringType())])


def read_outputs(spark: SparkSession, out: str) -> DataFrame:
    """All documents written, with the output they belong to."""
    return spark.read.schema(_WRITTEN).parquet(out)


def read_output(spark: SparkSession, out: str, output: str) -> DataFrame:
    """The messages of one output, as a table; only its folder is read."""
    return read_outputs(spark, out).filter(F.col("output") == output).drop("output")


def read_output_stream(spark: SparkSession, out: str, output: str = "raw") -> DataFrame:
    """The messages of one output as a stream, for instance for the enrichment worker."""
    documents = spark.readStream.schema(_WRITTEN).parquet(out)
    return documents.filter(F.col("output") == output).drop("output")

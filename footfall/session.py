"""Session settings the operators rely on, and where they may keep written state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Event times are UTC text; salts rotate at UTC midnight.
    "spark.sql.session.timeZone": "UTC",
    # JSON documents with a repeated key: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Above 8000 bytes of byte code the JVM interprets a method instead of compiling
    # it; such stages run better as separate, shorter projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # The rule follows every join key down through all projections it is made of; below
    # the validation these number in the thousands and planning takes minutes. Lookup
    # tables here are filtered by day before they are joined, so it finds nothing to prune.
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false",
    # A megabyte of Parquet holds some ten thousand requests or messages, and each takes far
    # longer to check than to read: splits of the usual 128 MB leave cores idle.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session; safe to call again."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written state, below the cluster's ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; a cluster session
    is refused, because executors do not share one machine's temporary files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="footfall-")
    return f"{shared.rstrip('/')}/footfall/{purpose}-{uuid.uuid4().hex}"

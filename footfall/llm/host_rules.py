"""Quality rules on documents and on the hosts that they come from.

Each document is measured alone. A host's rate of failed documents is shrunk towards
the rate of all hosts by a beta prior fitted to them, so that a host with few documents
is not judged by chance; hosts above the limit lose all their documents.

Null or empty texts have no words and fail. Documents without a source are judged alone.
Repeated rows are measured and returned each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import per_batch, written
from .words import Texts, mix, per_text, texts

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A host whose shrunk rate of failed documents is above this is rejected.
MAX_HOST_RATE = 0.5
#: Rows of one host are dealt to so many groups for the join with its verdict.
SALTS = 64

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, hash): whether it occurs twice or more, and whether it did before."""
    key = mix(hashes + owners.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, dtype=bool)
    ordered = key[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    often, again = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    again[order] = same[:-1]
    often[order] = same[:-1] | same[1:]
    return often, again


def _duplicate_lines(t: Texts) -> np.ndarray:
    if not len(t.data):
        return np.zeros(len(t.offsets) - 1, dtype=np.int64)
    breaks = np.flatnonzero(t.data == 10)
    starts = np.union1d(t.offsets[:-1], breaks + 1)
    starts = starts[starts < len(t.data)]
    ends = np.append(starts[1:], len(t.data))
    ends = ends - (t.data[ends - 1] == 10)
    solid = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(t.solid, out=solid[1:])
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    owners = np.searchsorted(t.offsets, starts, side="right") - 1
    # Empty texts share an offset with the next one; the last of these owns the bytes.
    _, again = _repeats(owners, t.spans(starts, ends))
    return np.bincount(owners[again], minlength=len(t.offsets) - 1)


def _repeated_words(t: Texts) -> np.ndarray:
    at, hashes = t.windows(t.hashes(), WINDOW)
    owners = t.owners()
    often, _ = _repeats(owners[at], hashes)
    cover = np.zeros(len(owners) + 1, dtype=np.int64)
    np.add.at(cover, at[often], 1)
    np.subtract.at(cover, at[often] + WINDOW, 1)
    return np.bincount(owners[np.cumsum(cover[:-1]) > 0], minlength=len(t.offsets) - 1)


def measure(t: Texts) -> list[np.ndarray]:
    """The values of ``MEASURES``, one array each."""
    points = t.solid & ((t.data & 0xC0) != 0x80)
    return [
        t.counts,
        per_text(points, t.offsets),
        per_text(SYMBOLS[t.data], t.offsets),
        _duplicate_lines(t),
        _repeated_words(t),
    ]


def _measuring():
    def work(batch: pa.RecordBatch):
        columns = list(zip(*[measure(t) for _, _, t in texts(batch.column(2))], strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(np.concatenate(c), pa.int64()) for c in columns]],
            ["doc_id", "source", *MEASURES],
        )

    return work


def document_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, the measures and ``base_failed`` of every whole text."""
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    schema = T.StructType(
        [T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("source", T.StringType())]
        + [T.StructField(name, T.LongType()) for name in MEASURES]
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    return own.mapInArrow(per_batch(_measuring), schema).withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and whether the host is kept.

    The prior's mean is the rate of all documents that have a host; its weight comes from
    how far the hosts' own rates spread beyond what chance explains (method of moments).
    """
    hosts = written(
        measured.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")),
        "hosts",
    )
    n, k = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    one = hosts.agg(
        F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.count("*").alias("hosts"),
        F.sum(k * k / n).alias("kk"),
    ).first()
    alpha, beta = prior(one["n"] or 0.0, one["k"] or 0.0, one["nn"] or 0.0, one["kk"] or 0.0, one["hosts"])
    rate = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", rate <= F.lit(max_rate))


def prior(n: float, k: float, nn: float, kk: float, hosts: int) -> tuple[float, float]:
    """Alpha and beta from the sums of n, k, n * n and k * k / n over the hosts."""
    mean = (k + 0.5) / (n + 1.0)
    spread = kk - (k * k / n if n else 0.0)  # sum of n * (rate - mean) ** 2
    chance = mean * (1 - mean)
    room = n - (nn / n if n else 0.0)
    between = (spread - (hosts - 1) * chance) / room if room > 0 else 0.0
    between = min(max(between, chance / 1001.0), chance / 2.0)  # a weight of 1 to 1000 documents
    weight = chance / between - 1.0
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document's measures, its host's shrunk rate, and whether it is kept."""
    measured = written(document_rules(docs), "measured")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    hosts = host_verdicts(measured, max_rate).select("source", "host_rate", "host_kept", salt)
    dealt = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *MEASURES), F.lit(SALTS)).cast("int"))
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return dealt.join(hosts, ["source", "_salt"], "left").drop("_salt").withColumn("kept", kept)

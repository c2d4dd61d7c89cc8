"""Quality by importance resampling.

Two generative models of hashed n-grams are counted: one on target text (documents
labelled good), one on the raw text of all documents. N-grams are taken from the words and
from their shapes (case, marks, length, line breaks, repetition of words just before). A
document's log weight is the sum over its n-grams of the log probability under the target
model less that under the raw model. The sample is drawn without replacement by Gumbel
top-k: Gumbel noise keyed by a seed and ``doc_id`` is added to the log weight and the k
greatest are kept, so that draws go by importance. k is a parameter; unless given it is
the share of good documents among the labelled ones, of all documents.

``sample`` is for filtering: there ``calibrated`` weights (a log odds, fitted on the
labelled documents to the mean log ratios and that of the worst stretch, so that length
does not count), noise scaled by ``TEMPERATURE`` and, unless given, k as how many
documents are likelier good than not make the draw nearly a cut.

Null and empty texts have no n-grams, a log weight of 0 and the odds of neutral text. Very
long texts are taken whole, in memory of some 40 times their bytes. Rows with the same
``doc_id`` and text get the same key and are kept or dropped together, so ties at the last
place are all kept. An empty table gives an empty result. Without labels of both kinds all
documents are kept. Columns of ``docs`` with the names of the weight and key are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import per_batch, written
from .toxicity import _logistic
from .words import Texts, mix, texts

#: At most so many labelled documents, of at most so many characters, are learned from.
TRAIN_ROWS = 8000
TRAIN_CHARS = 20_000
WORD_SLOTS, SHAPE_SLOTS = 1 << 15, 1 << 13
SMOOTHING = 0.5
STRETCH = 12
TEMPERATURE = 0.25
SEED = 20_240
CHUNK_BYTES = 1 << 19
HISTOGRAM = 4096

_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 3
_CLASS[np.frombuffer(b"!#*$%&|<>@=_~^+/\\{}[]", np.uint8)] = 4


def _within(flags: np.ndarray, t: Texts) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[t.ends] - sums[t.starts]


def shapes(t: Texts, words: np.ndarray) -> np.ndarray:
    """One number for the look of each word and its repetition."""
    kind = _CLASS[t.data]
    length = t.ends - t.starts
    upper = _within(kind == 1, t)
    letters = _within(kind <= 1, t)
    code = kind[t.starts] * 6 + kind[t.ends - 1]
    code = code * 6 + np.searchsorted([2, 4, 8, 13, 24], length, side="right")
    code = code * 2 + ((upper == letters) & (upper > 1))
    code = code * 3 + np.minimum(_within(kind == 4, t), 2)
    breaks = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(t.data == 10, out=breaks[1:])
    before = np.concatenate([[0], t.ends[:-1]])
    code = code * 2 + (breaks[t.starts] > breaks[np.minimum(before, t.starts)])
    since = np.arange(len(words)) - np.repeat(t.first[:-1], t.counts)
    again = np.zeros(len(words), dtype=np.int64)
    for back in (4, 3, 2, 1):
        same = np.zeros(len(words), dtype=bool)
        same[back:] = words[back:] == words[:-back]
        again[same & (since >= back)] = 1 if back > 1 else 2
    return code * 3 + again


def slots(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams of words and of shapes, each with the word that it begins at."""
    words = t.hashes(lower=True)
    looks = mix(shapes(t, words).astype(np.uint64) + np.uint64(1))
    out = []
    for source, sizes, many, base in ((words, (1, 2), WORD_SLOTS, 0), (looks, (1, 2, 3), SHAPE_SLOTS, WORD_SLOTS)):
        ats, all_ = [], []
        for size in sizes:
            at, hashes = t.windows(source, size)
            ats.append(at)
            all_.append((mix(hashes + np.uint64(size)) % np.uint64(many)).astype(np.int64) + base)
        out.append((np.concatenate(all_), np.concatenate(ats)))
    return out


def counts(t: Texts) -> np.ndarray:
    both = np.concatenate([s for s, _ in slots(t)])
    return np.bincount(both, minlength=WORD_SLOTS + SHAPE_SLOTS)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log probability of each slot under the target less that under the raw model."""
    out = np.empty(len(raw))
    for part in (slice(0, WORD_SLOTS), slice(WORD_SLOTS, None)):
        t, r = target[part].astype(float), raw[part].astype(float)
        share = (r + SMOOTHING) / (r.sum() + SMOOTHING * len(r))
        # What the target sample has not seen is smoothed towards the raw model.
        weight = SMOOTHING * len(r) * 0.02
        out[part] = np.log((t + weight * share) / (t.sum() + weight)) - np.log(share)
    return out


def importance(t: Texts, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean log ratios of word and shape n-grams with that of the worst stretch, and the sum."""
    n = len(t.offsets) - 1
    out = np.zeros((n, 3))
    whole = np.zeros(n)
    owners = t.owners()
    for i, (slot, at) in enumerate(slots(t)):
        value = ratio[slot]
        sums = np.bincount(owners[at], value, minlength=n)
        whole += sums
        out[:, i] = sums / np.maximum(np.bincount(owners[at], minlength=n), 1)
        if i == 1 and len(owners):
            each = np.bincount(at, value, minlength=len(owners)) / 3.0
            total = np.concatenate([[0.0], np.cumsum(each)])
            here = np.arange(len(owners))
            end = np.minimum(here + STRETCH, t.first[1:][owners])
            begin = np.maximum(end - STRETCH, t.first[:-1][owners])
            worst = (total[end] - total[begin]) / (end - begin)
            full = t.counts > 0
            out[full, 2] = np.minimum.reduceat(worst, t.first[:-1][full])
    return out, whole


def raw_counts(docs: DataFrame) -> np.ndarray:
    """N-grams of all documents by slot: one array for each task, added up by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_SLOTS + SHAPE_SLOTS, dtype=np.int64)
        for batch in batches:
            for _, _, t in texts(batch.column(0), CHUNK_BYTES):
                total += counts(t)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    own = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = own.toArrow()  # at most one row for each slot
    out = np.zeros(WORD_SLOTS + SHAPE_SLOTS, dtype=np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weights: np.ndarray | None  # None: nothing to learn from, everything is good
    share: float = 1.0  # of good documents among the labelled ones


def fit(own: list[str], good: list[int], raw: np.ndarray) -> Model:
    """A model of labelled texts against the raw counts."""
    target = np.zeros(len(raw), dtype=np.int64)
    chunks = list(texts(pa.array(own, pa.string()), CHUNK_BYTES))
    y = np.array(good, dtype=float)
    for low, high, t in chunks:
        keep = np.flatnonzero(y[low:high] == 1)
        for i in keep:
            target += counts(Texts(t.data[t.offsets[i] : t.offsets[i + 1]], np.array([0, t.offsets[i + 1] - t.offsets[i]])))
    ratio = log_ratios(target, raw)
    if not 0 < y.sum() < len(y):
        return Model(ratio, None)
    x = np.vstack([importance(t, ratio)[0] for _, _, t in chunks])
    return Model(ratio, _logistic(x, y, ridge=0.01, steps=100), float(y.mean()))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most ``TRAIN_ROWS`` labelled documents, drawn by hash, and all texts."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("_good")).filter(F.col("_good").isin(0, 1))
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id", "_good").limit(TRAIN_ROWS)
    short = docs.select("doc_id", F.col("text").alias("_text")).filter(F.length("_text") <= TRAIN_CHARS)
    rows = short.join(F.broadcast(drawn), "doc_id").select("doc_id", "_text", "_good").toArrow()
    ordered = sorted(zip(*[c.to_pylist() for c in rows.columns], strict=True))
    return fit([r[1] for r in ordered], [r[2] for r in ordered], raw_counts(docs))


def sample_key(weight: Column, doc_id: Column, seed: Column, temperature: float = 1.0) -> Column:
    """The log weight with Gumbel noise from a hash of the seed and ``doc_id``."""
    # Uniform, strictly between 0 and 1.
    uniform = (F.pmod(F.xxhash64(seed, doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(uniform)) * temperature


def weigh(
    docs: DataFrame,
    model: Model,
    names: tuple[str, str] = ("log_weight", "sample_key"),
    calibrated: bool = False,
    temperature: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """All columns of ``docs`` with its log weight and key; columns of these names are replaced."""
    docs = docs.drop(*names)

    def make():
        def work(batch: pa.RecordBatch):
            if model.weights is None:
                weight = np.full(batch.num_rows, 30.0)
            else:
                found = [importance(t, model.ratio) for _, _, t in texts(batch.column("text"), CHUNK_BYTES)]
                weight = np.concatenate([whole for _, whole in found])
                if calibrated:
                    weight = model.weights[0] + np.vstack([x for x, _ in found]) @ model.weights[1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], [*batch.schema.names, names[0]])

        return work

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType())])
    key = sample_key(F.col(names[0]), F.col("doc_id"), F.lit(seed), temperature)
    return docs.mapInArrow(per_batch(make), schema).withColumn(names[1], key)


def smallest_kept(keys: DataFrame, k: int) -> float:
    """The k-th greatest ``sample_key``, by ever finer histograms; ``keys`` is read repeatedly."""
    low, high, many = keys.agg(F.min("sample_key"), F.max("sample_key"), F.count("sample_key")).first()
    if k >= many:
        return float("-inf")
    if k == 0:
        return float("inf")
    above = 0
    for _ in range(8):
        if high <= low:
            break
        width = (high - low) / HISTOGRAM
        bucket = F.least(F.floor((F.col("sample_key") - low) / width), F.lit(HISTOGRAM - 1))
        inside = keys.filter(F.col("sample_key").between(low, high))
        rows = inside.groupBy(bucket.alias("bucket")).agg(
            F.count("*").alias("n"), F.min("sample_key").alias("least"), F.max("sample_key").alias("most")
        ).collect()
        for row in sorted(rows, key=lambda r: -r["bucket"]):
            if above + row["n"] >= k:
                low, high = row["least"], row["most"]
                break
            above += row["n"]
        if above + 1 == k:
            return high
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``log_weight``, ``sample_key`` and ``kept`` of every document."""
    model = train(docs, labels)
    keys = written(weigh(docs.select("doc_id", "text"), model, seed=seed).drop("text"), "keys")
    if k is None:
        k = math.ceil(model.share * keys.count())
    return keys.withColumn("kept", F.col("sample_key") >= F.lit(smallest_kept(keys, k)))


def sample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED
) -> DataFrame:
    """The documents of a sample by calibrated weights, with their own columns."""
    names = ("_log_weight", "_sample_key")
    model = train(docs, labels)
    weighed = written(weigh(docs, model, names, True, temperature, seed), "weighed")
    keys = weighed.select(F.col(names[0]).alias("log_weight"), F.col(names[1]).alias("sample_key"))
    if k is None:
        k = keys.filter("log_weight >= 0").count()
    return weighed.filter(F.col(names[1]) >= F.lit(smallest_kept(keys, k))).drop(*names)

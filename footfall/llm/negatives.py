"""Hard negatives by threshold joins on an inverted index with partial scores.

An anchor's positives are its best rows of the same label; a positive's negatives are the
best rows of other labels whose score lies in a window below the positive's. Both are
searched for as threshold joins: all rows whose inner product with the anchor reaches a
threshold. Dimensions are ordered by their energy. A row's last dimensions stay out of the
inverted index as long as the norm of what is left out, times the anchor's, cannot reach
the threshold. Partial scores are summed along the posting lists; whenever the norms of
the remaining dimensions cannot lift a pair to its threshold, the pair is dropped. Pairs
that are left get their remaining dimensions.

Thresholds begin where a bounded sample lets expect some more rows than wanted, and are
lowered for the windows that are not full, down to the window's lower end. A window is
done when it is full of rows above its threshold, or its threshold is its end: the
result is exact, whatever the sample.

Rows without an id, with a null label or a vector that is null or holds null or
non-finite components take no part; of rows with one id one takes part (least label, then
vector). Shorter vectors, also empty ones, are padded with zeros. Ties go to the smaller
id. A very long vector costs memory in proportion to a block's rows, whose number falls
with the length. Other columns are not read. An empty table, or one without two labels,
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import partitions, per_batch, written
from .whole import NONE, Shape, drawn, matrix, products, runs, shape, whole

#: Rows of the sample; rows of a block; anchors compared with it at once.
SAMPLE, BLOCK, ANCHORS = 4096, 2048, 256
#: Groups of labels that are dealt apart, so that an anchor meets its label's group alone.
GROUPS = 64
#: Rows expected above the first threshold for each row wanted; how much lower the next one is.
AHEAD, LOWER = 4, 8
#: Dimensions whose posting lists are summed before pairs are dropped anew.
STRIDE = 8

LONG = T.LongType()
WINDOW = T.StructType([T.StructField(n, LONG) for n in ("key", "low", "high")])
OPEN = T.StructType([*WINDOW.fields, T.StructField("least", LONG)])


@dataclass(frozen=True)
class Sample:
    """Rows that thresholds are guessed from, and the order of the dimensions."""

    shape: Shape
    ids: np.ndarray
    labels: list
    x: np.ndarray

    @property
    def order(self) -> np.ndarray:
        return np.argsort(-(self.x.astype(np.float64) ** 2).sum(axis=0), kind="stable")

    def scores(self, ids: np.ndarray, labels: list, x: np.ndarray, same: bool) -> list[np.ndarray]:
        """For each anchor the scores of the sample's rows that may be its own, highest first."""
        codes = {label: i for i, label in enumerate(dict.fromkeys(self.labels))}
        own = np.array([codes[label] for label in self.labels])
        asked = np.array([codes.get(label, -1) for label in labels])
        fits = ((asked[:, None] == own[None, :]) == same) & (ids[:, None] != self.ids[None, :])
        every = products(x, self.x).astype(np.int64)
        return [-np.sort(-score[ok]) for score, ok in zip(every, fits, strict=True)]


def threshold(scores: np.ndarray, low: int, high: int, rank: int) -> int:
    """The ``rank``-th best sample score in the window, or its end if there are fewer."""
    inside = scores[(scores >= low) & (scores <= high)]
    return int(inside[rank - 1]) if len(inside) >= rank else low


class Index:
    """Posting lists of a block, without the last dimensions that no threshold needs.

    ``reach`` is the least threshold in proportion to an anchor's length; ``order`` is how
    dimensions follow one another. Rows stand by how far they are indexed, furthest first,
    so that the list of a dimension is a run of rows from the first one on.
    """

    def __init__(self, ids: np.ndarray, labels: list, x: np.ndarray, order: np.ndarray, reach: float):
        x = x[:, order]
        rest = _norms(x)
        # First dimension of each row that is left out.
        end = np.minimum((rest * (1 + 1e-9) >= reach).sum(axis=1), x.shape[1])
        rows = np.argsort(-end, kind="stable")
        self.order, self.ids, self.labels = order, ids[rows], [labels[i] for i in rows.tolist()]
        #: rest[i, d]: norm of row i from dimension d on.
        self.x, self.rest, self.end = x[rows], rest[rows], end[rows]
        #: Values in the lists, 0 where a dimension is left out; how many rows each list has.
        self.indexed = np.where(np.arange(x.shape[1])[None, :] < self.end[:, None], self.x, 0)
        self.lengths = (self.end[:, None] > np.arange(x.shape[1])[None, :]).sum(axis=0)
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
        self.coded = np.array([self.codes[label] for label in self.labels])
        self.touched = 0

    def allowed(self, ids: np.ndarray, labels: list, same: bool) -> np.ndarray:
        """Which rows an anchor may be paired with."""
        coded = np.array([self.codes.get(label, -1) for label in labels])
        return ((coded[:, None] == self.coded[None, :]) == same) & (ids[:, None] != self.ids[None, :])

    def pairs(self, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchor, row and score of all allowed pairs whose score reaches the anchor's least."""
        a = anchors[:, self.order]
        rest, size = _norms(a), a.shape[1]
        bound = least.astype(np.float64) - 0.5
        part = np.zeros((len(a), len(self.x)), dtype=self.x.dtype)
        active, d = allowed.copy(), 0
        while d < size and active.mean() > 0.25:
            upto = min(d + STRIDE, size)
            listed = int(self.lengths[d])
            self.touched += int(self.lengths[d:upto].sum()) * len(a)
            part[:, :listed] += products(a[:, d:upto], self.indexed[:listed, d:upto])
            d = upto
            # What a row has not had yet begins where its lists end, or here.
            if (end := np.minimum(self.end, d)).min() == d:
                ahead = rest[:, d, None] * self.rest[None, :, d]
            else:
                ahead = rest[:, end] * self.rest[np.arange(len(self.x)), end][None, :]
            ahead *= 1 + 1e-9
            ahead += part
            active &= ahead >= bound[:, None]
        who, row = np.nonzero(active)
        score = part[who, row]
        while d < size and len(who):
            upto = min(d + STRIDE, size)
            self.touched += int((np.minimum(self.end[row], upto) - np.minimum(self.end[row], d)).sum())
            score = score + np.einsum("ij,ij->i", a[who, d:upto], self.indexed[row, d:upto])
            d = upto
            end = np.minimum(self.end[row], d)
            keep = score + rest[who, end] * self.rest[row, end] * (1 + 1e-9) >= bound[who]
            who, row, score = who[keep], row[keep], score[keep]
        # The dimensions left out of the index, for the pairs that are left.
        left_out = self.x - self.indexed if len(who) and int(self.end.min()) < size else None
        for i in range(0, len(who) if left_out is not None else 0, 1 << 14):
            some = slice(i, i + (1 << 14))
            score[some] += np.einsum("ij,ij->i", a[who[some]], left_out[row[some]])
        keep = score >= least[who]
        return who[keep], row[keep], score[keep].astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of the rows from each dimension on; 0 beyond the last one."""
    squares = np.zeros((len(x), x.shape[1] + 1))
    squares[:, :-1] = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares)


def _guessing(sample: Sample, same: bool, rank: int):
    """Anchors with a threshold for each of their windows, and the least of them."""

    def make():
        def work(batch: pa.RecordBatch):
            x = matrix(batch.column("v"), sample.shape.size, sample.shape.kind)
            norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            windows, least, reach = [], [], []
            for i in range(0, len(x), ANCHORS):
                some = batch.slice(i, ANCHORS)
                scores = sample.scores(some.column("vec_id").to_numpy(), some.column("label").to_pylist(), x[i : i + ANCHORS], same)
                for own, held in zip(scores, some.column("windows").to_pylist(), strict=True):
                    windows.append([w | {"least": threshold(own, w["low"], w["high"], rank)} for w in held])
            for norm, held in zip(norms, windows, strict=True):
                least.append(min(w["least"] for w in held))
                reach.append(least[-1] / norm if least[-1] > 0 and norm else 0.0)
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in OPEN.names]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("vec_id", "label", "v")), pa.array(windows, kind),
                 pa.array(least, pa.int64()), pa.array(reach, pa.float64())],
                ["vec_id", "label", "v", "windows", "least", "reach"],
            )

        return work

    return make


def _joining(sample: Sample, same: bool, want: int, reach: float):
    """Rows sorted by block, members first; holds one index and some of its anchors."""
    size, kind, order = sample.shape.size, sample.shape.kind, sample.order

    def read(batch: pa.RecordBatch) -> tuple:
        return batch.column("vec_id").to_numpy(), batch.column("label").to_pylist(), matrix(batch.column("v"), size, kind)

    def joined(parts: list[tuple]) -> Index:
        ids, labels, x = zip(*parts, strict=True)
        return Index(np.concatenate(ids), [label for own in labels for label in own], np.concatenate(x), order, reach)

    def compared(index: Index, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, x = read(asked)
        who, row, score = index.pairs(x, asked.column("least").to_numpy(), index.allowed(ids, labels, same))
        found = index.ids[row]
        best = np.lexsort((found, ~score, who))
        found, score = found[best], score[best]
        edges = np.searchsorted(who[best], np.arange(len(ids) + 1))
        counts, keys, takes = [], [], []
        for i, windows in enumerate(asked.column("windows").to_pylist()):
            a, b = int(edges[i]), int(edges[i + 1])
            if a == b:
                continue
            falling = ~score[a:b]
            for w in windows:
                first = a + int(np.searchsorted(falling, ~w["high"], side="left"))
                last = min(a + int(np.searchsorted(falling, ~w["least"], side="right")), first + want)
                if last > first:
                    takes.append(np.arange(first, last))
                    counts.append(last - first)
                    keys.append((ids[i], w["key"]))
        take = np.concatenate(takes) if takes else np.zeros(0, dtype=np.int64)
        own = np.repeat(np.array(keys, dtype=np.int64).reshape(-1, 2), counts, axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(found[take]), pa.array(score[take])],
            ["vec_id", "key", "found", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in runs(batch, ["group", "block", "role"]):
                some = batch.slice(a, b - a)
                own = (some.column("group")[0].as_py(), some.column("block")[0].as_py())
                if own != key:
                    key, parts, index = own, [], None
                if some.column("role")[0].as_py() == 0:
                    parts.append(read(some))
                    continue
                if not parts:
                    continue
                index = index or joined(parts)
                for i in range(0, some.num_rows, ANCHORS):
                    yield compared(index, some.slice(i, ANCHORS))

    return run


class _Rows:
    """The rows in blocks by group of labels, and the sample."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.shape = shape(rows)
        sample = drawn(rows, self.shape.rows, self.shape.size, SAMPLE).orderBy("vec_id").toArrow().combine_chunks()
        x = matrix(sample.column("v").combine_chunks(), self.shape.size, self.shape.kind) if sample.num_rows else None
        self.sample = Sample(self.shape, sample.column("vec_id").to_numpy(), sample.column("label").to_pylist(), x)
        self.group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
        most = max(1, min(BLOCK, (1 << 18) // max(self.shape.size, 1)))
        # At most one row for each group.
        counts = rows.groupBy(self.group.alias("group")).count().collect()
        self.cut = {r["group"]: -(-r["count"] // most) for r in counts}

    def first_rank(self, want: int) -> int:
        return -(-AHEAD * want * len(self.sample.ids) // self.shape.rows)

    def _join(self, asked: DataFrame, same: bool, want: int, reach: float) -> DataFrame:
        blocks = F.create_map(*(F.lit(x) for pair in self.cut.items() for x in pair))[F.col("group")]
        shared = ["group", "block", "role", "vec_id", "label", "v", "windows", "least"]
        none = [F.lit(None).cast(T.ArrayType(OPEN)).alias("windows"), F.lit(None).cast(LONG).alias("least")]
        held = self.rows.select("*", self.group.alias("group"), F.lit(0).alias("role"), *none).withColumn(
            "block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
        )
        groups = F.array(self.group) if same else F.array(*(F.lit(g) for g in self.cut))
        queries = asked.withColumn("group", F.explode(groups)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), blocks - 1))
        ).withColumn("role", F.lit(1))
        dealt = held.select(*shared).unionByName(queries.select(*shared)).repartition(
            partitions(self.rows.sparkSession), "group", "block"
        ).sortWithinPartitions("group", "block", "role")
        fields = [T.StructField(n, LONG) for n in ("vec_id", "key", "found", "score")]
        return dealt.mapInArrow(_joining(self.sample, same, want, reach), T.StructType(fields))

    def fill(self, anchors: DataFrame, windows: DataFrame, same: bool, want: int) -> DataFrame:
        """The best ``want`` rows of each window: ``vec_id``, ``key``, ``found``, ``score``, ``rank``.

        ``windows`` has ``vec_id``, ``key``, ``low`` and ``high``; ``key`` names a window of an anchor.
        """
        rank, full = self.first_rank(want), []
        schema = T.StructType([
            *(anchors.schema[n] for n in ("vec_id", "label", "v")), T.StructField("windows", T.ArrayType(OPEN)),
            T.StructField("least", LONG), T.StructField("reach", T.DoubleType()),
        ])
        while True:
            held = windows.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct(*WINDOW.names))).alias("windows"))
            asked = written(
                anchors.select("vec_id", "label", "v").join(held, "vec_id").mapInArrow(
                    per_batch(_guessing(self.sample, same, rank)), schema
                ),
                "negatives-asked",
            )
            reach = asked.agg(F.min("reach")).first()[0]
            if reach is None:
                break
            best = Window.partitionBy("vec_id", "key").orderBy(F.desc("score"), "found")
            tops = written(
                self._join(asked, same, want, reach).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= want),
                "negatives-found",
            )
            counts = tops.groupBy("vec_id", "key").agg(F.count("*").alias("many"))
            states = asked.select("vec_id", F.inline("windows")).join(counts, ["vec_id", "key"], "left")
            done = (F.col("many") >= want) | (F.col("least") <= F.col("low"))
            states = written(states.withColumn("done", F.coalesce(done, F.lit(False))), "negatives-windows")
            full.append(tops.join(states.filter("done").select("vec_id", "key"), ["vec_id", "key"]))
            windows = states.filter("NOT done").select("vec_id", *WINDOW.names)
            rank *= LOWER
        out = full[0] if full else None
        for more in full[1:]:
            out = out.unionByName(more)
        return out


def mine(
    vectors: DataFrame, label: Column, anchors: Column, scale: float = 256.0,
    positives: int = 5, wanted: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``vectors`` has ``vec_id`` (a whole number) and ``embedding``; ``label`` is a column of it,
    ``anchors`` says of a ``vec_id`` whether its row is an anchor. Components count as the floor
    of ``scale`` times themselves. A negative scores ``low`` to ``high`` percent of its positive.
    Scores beyond 64 bits fail with an error.
    """
    spark = vectors.sparkSession
    rows = written(whole(vectors, scale, label.alias("label")), "negatives-rows")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return spark.createDataFrame([], result)
    dealt = _Rows(rows)
    own = rows.filter(anchors)
    ends = F.lit(NONE).cast(LONG).alias("low"), F.lit(2**63 - 1).cast(LONG).alias("high")
    found = dealt.fill(own, own.select("vec_id", F.lit(0).cast(LONG).alias("key"), *ends), True, positives)
    if found is None:
        return spark.createDataFrame([], result)
    pairs = written(
        found.select("vec_id", F.col("found").alias("key"), F.col("score").alias("positive_score")), "positives"
    )
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = pairs.select(
        "vec_id", "key", F.ceil(score * low / 100).cast(LONG).alias("low"), F.floor(score * high / 100).cast(LONG).alias("high")
    ).filter("low <= high")
    mined = dealt.fill(own, windows, False, wanted)
    if mined is None:
        return spark.createDataFrame([], result)
    return mined.join(pairs, ["vec_id", "key"]).select(
        F.col("vec_id").alias("anchor_id"), F.col("key").alias("positive_id"), "rank",
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )

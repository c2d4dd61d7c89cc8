"""Exact top-k search by inner product with a table of pivot distances.

Every vector keeps its distances to many pivots. By the triangle inequality the distance
of two vectors is at least the largest difference of their distances to a pivot, and with
both norms that bounds their inner product from above. Vectors are grouped by their
nearest pivot. A query leaves out groups whose ranges of distances rule out all their
members; within a group it evaluates members in the order of their bounds and stops at
the first bound below its k-th score. A bounded sample of vectors gives every query a
k-th score to begin with. Nothing else is approximate, so the result is exact.

Pivots are spread over the sample, each the vector furthest from those before. Groups are
cut into blocks of bounded size; a task holds one block and sees its queries as a stream.

Vectors that are null or hold null or non-finite components and rows without an id take no
part; of rows with one id one takes part (the least vector). Shorter vectors, also empty
ones, are padded with zeros. Ties go to the smaller id. A very long vector costs memory
in proportion to a block's members, whose number falls with the length. Other columns are
not read. An empty table gives an empty result.
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
from .whole import NONE, Shape, drawn, lists, matrix, products, runs, shape, whole

#: Vectors of the sample, and pivots among them.
SAMPLE, PIVOTS = 4096, 48
#: Members of a block, queries compared with it at once, members evaluated per step.
BLOCK, QUERIES, STEP = 2048, 256, 32


@dataclass(frozen=True)
class Table:
    """Pivots, the sample for first scores, and the ranges of each group."""

    shape: Shape
    pivots: np.ndarray
    ids: np.ndarray
    sample: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lengths and the distances to all pivots."""
        square = (x * x).sum(axis=1)
        apart = square[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * products(x, self.pivots)
        return square.astype(np.float64), np.sqrt(apart.astype(np.float64))

    def first(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """The k-th score of each query among the sample; NONE if there are fewer."""
        score = products(x, self.sample).astype(np.int64)
        score[ids[:, None] == self.ids[None, :]] = NONE
        if score.shape[1] < k:
            return np.full(len(x), NONE)
        return np.partition(score, score.shape[1] - k, axis=1)[:, -k]


@dataclass(frozen=True)
class Ranges:
    """Of each group its least and largest distance to every pivot, and longest vector."""

    groups: np.ndarray
    low: np.ndarray
    high: np.ndarray
    square: np.ndarray


def most_product(square: np.ndarray, other: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The largest inner product of vectors at least ``apart`` from each other."""
    both = square + other
    return (both - apart * apart) / 2 + 1e-9 * both + 0.5


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample, each the furthest from all that were chosen before it."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    taken, nearest = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(taken) < count and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def _indexing(table: Table):
    def make():
        def work(batch: pa.RecordBatch):
            square, apart = table.distances(matrix(batch.column("v"), table.shape.size, table.shape.kind))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(apart.argmin(axis=1).astype(np.int32)), pa.array(square), lists(apart)],
                [*batch.schema.names, "cell", "square", "apart"],
            )

        return work

    return make


def _routing(table: Table, ranges: Ranges, k: int):
    """Queries with their first k-th score and the groups that may hold better ones."""

    def make():
        def work(batch: pa.RecordBatch):
            apart = matrix(batch.column("apart"), len(table.pivots), np.float64)
            x = matrix(batch.column("v"), table.shape.size, table.shape.kind)
            least = table.first(batch.column("vec_id").to_numpy(), x, k)
            gap = np.zeros((len(x), len(ranges.groups)))
            for p in range(len(table.pivots)):
                own = apart[:, p : p + 1]
                np.maximum(gap, np.maximum(ranges.low[None, :, p] - own, own - ranges.high[None, :, p]), out=gap)
            open_ = most_product(batch.column("square").to_numpy()[:, None], ranges.square[None, :], gap) >= least[:, None]
            counts = np.concatenate([[0], open_.sum(axis=1).cumsum()]).astype(np.int32)
            cells = ranges.groups[np.nonzero(open_)[1]].astype(np.int32)
            kept = [batch.column(n) for n in ("vec_id", "v", "square", "apart")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(least, pa.int64()), pa.ListArray.from_arrays(pa.array(counts), pa.array(cells))],
                ["vec_id", "v", "square", "apart", "least", "cells"],
            )

        return work

    return make


class Block:
    """Some members of a group with their rows of the pivot table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, square: np.ndarray, apart: np.ndarray):
        self.ids, self.x, self.square, self.apart = ids, x, square, np.ascontiguousarray(apart.T)

    def best(
        self, ids: np.ndarray, x: np.ndarray, square: np.ndarray, apart: np.ndarray, least: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of each query's best k members, none below ``least``; evaluations."""
        gap = np.zeros((len(x), len(self.x)))
        for p, own in enumerate(self.apart):
            np.maximum(gap, np.abs(apart[:, p : p + 1] - own[None, :]), out=gap)
        bound = most_product(square[:, None], self.square[None, :], gap)
        bound[(ids[:, None] == self.ids[None, :]) | (bound < least[:, None])] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        score = np.full((len(x), k), NONE, dtype=np.int64)
        found = np.full((len(x), k), np.iinfo(np.int64).max)
        evaluated = 0
        for at in range(0, len(self.x), STEP):
            last = np.maximum(score[:, -1], least)
            rows = np.flatnonzero((bound[:, at] > -np.inf) & (bound[:, at] >= last))
            if not len(rows):
                break
            some = order[rows, at : at + STEP]
            exact = np.einsum("ij,ikj->ik", x[rows], self.x[some]).astype(np.int64)
            exact[(bound[rows, at : at + STEP] == -np.inf) | (exact < least[rows, None])] = NONE
            evaluated += exact.size
            every = np.concatenate([score[rows], exact], axis=1)
            whose = np.concatenate([found[rows], self.ids[some]], axis=1)
            whose[every == NONE] = np.iinfo(np.int64).max
            # ~x reverses the order of integers without overflow.
            first = np.lexsort((whose, ~every), axis=1)[:, :k]
            score[rows] = np.take_along_axis(every, first, axis=1)
            found[rows] = np.take_along_axis(whose, first, axis=1)
        return score, found, evaluated


def _comparing(table: Table, k: int):
    """Rows sorted by block, members first; holds one block and some of its queries."""
    size, kind, many = table.shape.size, table.shape.kind, len(table.pivots)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return (
            batch.column("vec_id").to_numpy(), matrix(batch.column("v"), size, kind),
            batch.column("square").to_numpy(), matrix(batch.column("apart"), many, np.float64),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in runs(batch, ["cell", "block", "role"]):
                some = batch.slice(a, b - a)
                own = (some.column("cell")[0].as_py(), some.column("block")[0].as_py())
                if own != key:
                    key, parts, block = own, [], None
                if some.column("role")[0].as_py() == 0:
                    parts.append(read(some))
                    continue
                block = block or Block(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                for i in range(0, some.num_rows, QUERIES):
                    batch_ids, *rest = read(asked := some.slice(i, QUERIES))
                    score, found, _ = block.best(batch_ids, *rest, asked.column("least").to_numpy(), k)
                    query, place = np.nonzero(score != NONE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(batch_ids[query]), pa.array(found[query, place]), pa.array(score[query, place])],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's best ``k`` others.

    ``vectors`` has ``vec_id`` (a whole number) and ``embedding``; ``queries`` says of a
    ``vec_id`` whether its vector is a query. Components count as the floor of ``scale``
    times themselves. Scores beyond 64 bits fail with an error.
    """
    spark = vectors.sparkSession
    long, double = T.LongType(), T.DoubleType()
    rows = written(whole(vectors, scale), "pivot-rows")
    sizes = shape(rows)
    sample = drawn(rows, sizes.rows, sizes.size, SAMPLE).orderBy("vec_id").toArrow().combine_chunks()
    ids = sample.column("vec_id").to_numpy()
    own = matrix(sample.column("v").combine_chunks(), sizes.size, sizes.kind) if len(ids) else np.zeros((0, sizes.size))
    result = T.StructType([T.StructField(n, long) for n in ("query_id", "vec_id", "score")])
    if not sizes.rows:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    table = Table(sizes, choose_pivots(own, PIVOTS), ids, own)

    members = written(
        rows.mapInArrow(per_batch(_indexing(table)), T.StructType([
            *rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("square", double),
            T.StructField("apart", T.ArrayType(double)),
        ])),
        "pivot-table",
    )
    # At most one row for each pivot.
    least = [f(F.col("apart")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(len(table.pivots))]
    groups = members.groupBy("cell").agg(F.max("square").alias("square"), F.count("*").alias("many"), *least).toArrow()
    column = lambda n: groups.column(n).to_numpy()
    ranges = Ranges(
        column("cell"), *(np.stack([column(f"{n}{i}") for i in range(len(table.pivots))], axis=1) for n in ("low", "high")),
        column("square"),
    )
    most = max(1, min(BLOCK, (1 << 18) // max(sizes.size, 1)))
    cut = {int(c): -(-int(n) // most) for c, n in zip(ranges.groups, column("many"), strict=True)}
    blocks = F.create_map(*(F.lit(x) for pair in cut.items() for x in pair))[F.col("cell")]

    route = T.StructType([
        *(members.schema[n] for n in ("vec_id", "v", "square", "apart")), T.StructField("least", long),
        T.StructField("cells", T.ArrayType(T.IntegerType())),
    ])
    asked = members.filter(queries).mapInArrow(per_batch(_routing(table, ranges, k)), route)
    shared = ["cell", "block", "role", "vec_id", "v", "square", "apart", "least"]
    asked = asked.withColumn("cell", F.explode("cells")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), blocks - 1))
    ).withColumn("role", F.lit(1)).select(*shared)
    held = members.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn(
        "role", F.lit(0)
    ).withColumn("least", F.lit(NONE)).select(*shared)
    keys = ["cell", "block"]
    dealt = held.unionByName(asked).repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "role")
    found = written(dealt.mapInArrow(_comparing(table, k), result), "pivot-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


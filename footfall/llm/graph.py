"""Connected components of a distributed edge list.

Rounds of large-star and small-star steps: every node's larger neighbours, then its
smaller ones, are tied to the smallest one known. Steps are joins with a per-node minimum;
the rows of a node with very many neighbours are salted, the minimum is pre-aggregated.
Each round is written to the shared folder, so none is ever repeated. A list of few edges
(they are counted first) needs no rounds: one task finds its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written

SALTS = 8
#: Edges that one task may take, some 100 bytes each.
FEW = 100_000


def _tied(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """Edges (a, b) with the minimum ``m`` of their node a."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    dealt = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return dealt.join(minima.select("a", "m", salts), ["a", "_salt"]).select("a", "b", "m")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges point from the larger to the smaller."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = _tied(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = _tied(large, least)
    onward = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (all but the roots) with their roots, of struct nodes."""
    parent: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kind = names = None
    for batch in batches:
        kind = batch.column("a").type
        names = [field.name for field in kind]
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(tuple(x.values())), find(tuple(y.values()))
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(parent)]
    rows = [(dict(zip(names, x, strict=True)), dict(zip(names, r, strict=True))) for x, r in found if x != r]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["node", "root"]
        )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of all nodes that are not roots.

    ``edges`` has ``a`` and ``b`` of one struct type without nulls; direction, repeats and loops do not
    matter. Nodes missing from the result are roots of their own.
    """
    current = written(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _mark(current)
    if mark[0] <= FEW:
        kind = current.schema["a"].dataType
        schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])
        return written(current.coalesce(1).mapInArrow(_in_one_task, schema), "roots")
    while True:
        current = written(_round(current), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Near-duplicate vectors by product quantisation.

Coarse lists come from k-means, the residual of a vector to its list's centre is coded by
one codeword per subspace. A query looks into every list that can hold a vector within the
radius: one further from the query than the radius beyond the plane between two centres
cannot. Within a list, distances are table lookups on codes; a code stands for a vector
at a stored distance from it, so every vector whose code is within the radius plus that
distance is compared by its exact cosine. Probes and candidates thus miss nothing.

Vectors are compared when labels are equal and not null. Vectors that are null, empty,
zero or hold null or non-finite components link with nothing. Equal vectors of a label are
one class from the start, counted and not paired. Lists are cut into blocks of bounded
size, each of which sees its queries as a stream. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .store import partitions, per_batch, written

COSINE = 0.98
#: Vectors that the index is fitted on, its lists, subspaces and codewords.
SAMPLE = 8192
LISTS, SUBSPACES, CODEWORDS = 128, 8, 64
ROUNDS = 8
#: Members in a block of a list, about; queries compared with it at once.
BLOCK, QUERIES = 2048, 256
SLACK = 1e-6
SALTS = 16


@dataclass(frozen=True)
class Index:
    centres: np.ndarray  # (lists, dimensions)
    words: tuple[np.ndarray, ...]  # per subspace (codewords, dimensions of the subspace)
    edges: tuple[int, ...]  # where the subspaces begin, and the dimensions

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and distance between the vector and its code."""
        lists = _squares(x, self.centres).argmin(axis=1)
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.words)), dtype=np.uint8)
        error = np.zeros(len(x))
        for i, own in enumerate(self.words):
            part = rest[:, self.edges[i] : self.edges[i + 1]]
            codes[:, i] = _squares(part, own).argmin(axis=1)
            error += ((part - own[codes[:, i]]) ** 2).sum(axis=1)
        return lists, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and list that may hold a vector within the radius."""
        near = _squares(x, self.centres)
        gaps = np.sqrt(_squares(self.centres, self.centres))
        np.fill_diagonal(gaps, np.inf)
        # Distance of x beyond the plane between a list's centre and any other centre.
        ok = np.ones(near.shape, dtype=bool)
        for other in range(len(self.centres)):
            ok &= near - near[:, other : other + 1] <= 2 * (radius + SLACK) * np.maximum(gaps[:, other], 1e-12)
        return np.nonzero(ok)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres; at most as many as there are distinct vectors."""
    x = np.unique(x, axis=0) if len(x) < 4 * k else x
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _squares(x, centres).argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def fit(sample: np.ndarray) -> Index:
    """An index of unit vectors."""
    centres = _means(sample, LISTS, 1)
    rest = sample - centres[_squares(sample, centres).argmin(axis=1)]
    size = sample.shape[1]
    many = min(SUBSPACES, size)
    edges = tuple(size * i // many for i in range(many + 1))
    words = tuple(_means(rest[:, a:b], CODEWORDS, 2 + i) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return Index(centres, words, edges)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _indexing(models: dict[int, Index], radius: float):
    """Each class as a member of its list and as a query to the lists that it probes."""

    def make():
        def work(batch: pa.RecordBatch):
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                yield indexed(batch.filter(pa.array(sizes == size)))

        def indexed(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _unit(_matrix(batch.column("vector")))
            model = models[x.shape[1]]
            lists, codes, errors = model.coded(x)
            query, probed = model.probes(x, radius)
            rows = np.concatenate([np.arange(len(x)), query])
            role = np.concatenate([np.zeros(len(x), np.int8), np.ones(len(query), np.int8)])
            where = np.concatenate([lists, probed]).astype(np.int32)
            codes = pa.array([c.tobytes() for c in codes], pa.binary())
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())
            )
            take = pa.array(rows)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("label").take(take), batch.column("size").take(take), pa.array(where),
                    pa.array(role), batch.column("node").take(take), batch.column("many").take(take),
                    flat.take(take), codes.take(take), pa.array(errors[rows]),
                ],
                ["label", "size", "list", "role", "node", "many", "unit", "code", "error"],
            )

        return work

    return make


class _Block:
    """Members of one block, and which of them are known to be connected."""

    def __init__(self, parts: list[pa.RecordBatch], models: dict[int, Index], where: int, radius: float, cosine: float):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.x = _matrix(whole.column("unit"))
        self.model = models[self.x.shape[1]]
        self.centre = self.model.centres[where]
        self.codes = np.frombuffer(b"".join(whole.column("code").to_pylist()), np.uint8).reshape(len(self.x), -1)
        self.reach = (radius + SLACK + whole.column("error").to_numpy()) ** 2
        self.many = whole.column("many").to_numpy()
        self.nodes = whole.column("node").to_pylist()
        self.group = np.arange(len(self.x))
        self.cosine = cosine

    def links(self, nodes: list, x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """How many vectors each query links with here, and edges that connect them."""
        near = np.zeros((len(x), len(self.x)))
        rest = x - self.centre
        for i, words in enumerate(self.model.words):
            table = _squares(rest[:, self.model.edges[i] : self.model.edges[i + 1]], words)
            near += table[:, self.codes[:, i]]
        query, member = np.nonzero(near <= self.reach[None, :] + SLACK)
        exact = np.einsum("ij,ij->i", x[query], self.x[member])
        keep = exact >= self.cosine
        query, member = query[keep], member[keep]
        counts = np.bincount(query, self.many[member], minlength=len(x)).astype(np.int64)
        edges = []
        bounds = np.searchsorted(query, np.arange(len(x) + 1))
        for i in range(len(x)):
            own = member[bounds[i] : bounds[i + 1]]
            if not len(own):
                continue
            groups = np.unique(self.group[own])
            edges += [(nodes[i], self.nodes[g]) for g in groups.tolist() if self.nodes[g] != nodes[i]]
            if len(groups) > 1:
                self.group[np.isin(self.group, groups)] = groups[0]
        return counts, edges


_NODE = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])


def _comparing(models: dict[int, Index], radius: float, cosine: float):
    """Rows sorted by block, members first; holds one block and a batch of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            keys = [batch.column(n).to_numpy() for n in ("size", "list", "block")]
            labels = batch.column("label").to_pylist()
            roles = batch.column("role").to_numpy()
            differ = np.zeros(len(roles), dtype=bool)
            differ[0] = True
            for k in [*keys, roles]:
                differ[1:] |= k[1:] != k[:-1]
            differ[1:] |= np.array([a != b for a, b in zip(labels, labels[1:], strict=False)], dtype=bool)
            change = [*np.flatnonzero(differ).tolist(), len(roles)]
            for a, b in zip(change, change[1:], strict=False):
                own = (labels[a], *[int(k[a]) for k in keys])
                if own != key:
                    key, parts, block = own, [], None
                if roles[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if not parts:
                    continue  # a probed list without members of this label
                block = block or _Block(parts, models, key[2], radius, cosine)
                for i in range(a, b, QUERIES):
                    some = batch.slice(i, min(QUERIES, b - i))
                    nodes = some.column("node").to_pylist()
                    counts, edges = block.links(nodes, _matrix(some.column("unit")))
                    found = np.flatnonzero(counts)
                    rows = [(nodes[j], None, int(counts[j])) for j in found] + [(p, q, 0) for p, q in edges]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], _NODE), pa.array([r[1] for r in rows], _NODE),
                         pa.array([r[2] for r in rows], pa.int64())],
                        ["a", "b", "links"],
                    )

    return run


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``. ``component_id`` is the least
    ``vec_id`` that is reachable, ``kept`` whether it is the vector's own.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine))
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    valid = own.filter(usable(F.col("vector"), F.col("label")))
    node = F.struct(F.xxhash64("label", "vector").alias("h1"), F.xxhash64("vector", F.lit(1), "label").alias("h2"))
    keyed = valid.withColumn("node", node)
    classes = written(
        keyed.groupBy("node").agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("many"),
            F.min("vec_id").alias("least"),
        ).withColumn("size", F.size("vector")),
        "vectors",
    )
    sizes = [r["size"] for r in classes.select("size").distinct().collect()]
    models = {}
    for size in sizes:
        drawn = classes.filter(F.col("size") == size).select("node", "vector").orderBy(F.xxhash64("node"), "node")
        models[size] = fit(_unit(_matrix(drawn.limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks())))

    double, node_type = T.ArrayType(T.DoubleType()), classes.schema["node"].dataType
    schema = T.StructType([
        T.StructField(n, t) for n, t in (
            ("label", T.StringType()), ("size", T.IntegerType()), ("list", T.IntegerType()), ("role", T.ByteType()),
            ("node", node_type), ("many", T.LongType()), ("unit", double), ("code", T.BinaryType()),
            ("error", T.DoubleType()),
        )
    ])
    rows = written(classes.mapInArrow(per_batch(_indexing(models, radius)), schema), "indexed")
    blocks = rows.filter("role = 0").groupBy("label", "size", "list").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("blocks")
    )
    placed = rows.join(blocks, ["label", "size", "list"])
    block = F.when(
        F.col("role") == 0, F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    ).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("block", F.explode(block)).drop("blocks")
    keys = ["label", "size", "list", "block"]
    found = written(
        dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "role", "node").mapInArrow(
            _comparing(models, radius, cosine),
            T.StructType([T.StructField("a", node_type), T.StructField("b", node_type), T.StructField("links", T.LongType())]),
        ),
        "links",
    )
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = graph.components(found.filter("b IS NOT NULL").select("a", "b"))
    joined = classes.select("node", "least").join(links, "node", "left").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    result = joined.join(least, "root").select("node", "links", "component_id", salts)
    dealt = keyed.select("vec_id", "node", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    linked = dealt.join(result, ["node", "_salt"]).select(
        "vec_id", (F.coalesce("links", F.lit(1)) - 1).cast("long").alias("n_links"), "component_id"
    )
    alone = own.filter(~usable(F.col("vector"), F.col("label"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word shingles columns of an incidence matrix; the product with its
transpose counts shared shingles. Equal sets are one node from the start. Only part of a
node's columns is multiplied: of sets that overlap enough, the first columns in any fixed
order must share some (prefix filter). Columns are blocked by shingle, each block is
multiplied alone, partial counts of a pair are added up, and pairs whose count cannot
reach the bound that their sizes set are discarded. Those left are compared exactly.

Columns with very many nodes would make all pairs of them. They are left out at first: a
prefix somewhat longer than needed still finds every pair, unless many of a node's columns
are such. Those nodes are joined anew among each other, on their whole sets, with the
rarest columns first. Where even these are frequent, nodes are compared with the column's
hub, the node with most such columns; the pairs that this leaves in different components
are then multiplied in full.

Null texts and texts without words have an empty set and link with nothing. Texts with
fewer words than a shingle are one shingle. Repeated rows fall into one node; rows without
``doc_id`` count, but do not name a component unless all of its rows have none. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .store import partitions, per_batch, written
from .words import Texts, mix, texts

SHINGLE = 5
#: Nodes link when PERCENT of their union is shared.
PERCENT = 75
#: Columns of more nodes than this are left out of the first product.
HOT = 64
#: The prefix is longer than needed by 1 in EXTRA columns; a node with more than 1 in
#: TOLERATED of its columns left out is joined anew.
EXTRA, TOLERATED = 10, 25
#: Pairs that a block holds before it adds them up, and sets that a task remembers.
HELD_PAIRS = 1 << 21
KEPT_SETS = 100_000
SALTS = 16
#: Nodes in a block of rows, about.
ROW_BLOCK = 1024


def shingles(t: Texts) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    words = t.hashes(lower=True)
    at, hashes = t.windows(words, SHINGLE)
    edges = np.searchsorted(at, t.first)
    out = []
    for i, many in enumerate(t.counts):
        if many >= SHINGLE:
            out.append(np.unique(hashes[edges[i] : edges[i + 1]]))
        elif many:
            short = np.uint64(many)
            with np.errstate(over="ignore"):
                for w in words[t.first[i] : t.first[i + 1]]:
                    short = (short * np.uint64(0x9E3779B97F4A7C15) + w) ^ (w >> np.uint64(7))
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit number of a set."""
    both = np.array([mix(own.copy()).sum(dtype=np.uint64) ^ np.uint64(len(own))], dtype=np.uint64)
    return int(mix(both).view(np.int64)[0])


def prefix_length(n):
    """How many columns of a node are multiplied; for integers, arrays and Spark columns alike."""
    if isinstance(n, Column):
        return F.least(n, F.floor(n / 4) + 1 + F.floor((n + EXTRA - 1) / EXTRA))
    return np.minimum(n, n // 4 + 1 + (n + EXTRA - 1) // EXTRA)


def _needed(a: Column, b: Column) -> Column:
    """Shared shingles that sets of these sizes need."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def _rows_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", id_type), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("columns", T.ArrayType(T.LongType())),
    ])


def _hashing():
    """Each text's node, and the node's prefix where a task meets the node first."""
    met: set[tuple[int, int]] = set()

    def work(batch: pa.RecordBatch):
        for low, high, t in texts(batch.column("text")):
            fps, sizes, prefixes = [], [], []
            for own in shingles(t):
                node = (fingerprint(own), len(own))
                fps.append(node[0] if len(own) else None)
                sizes.append(len(own))
                if not len(own) or node in met:
                    prefixes.append(None)
                    continue
                if len(met) >= KEPT_SETS:
                    met.clear()
                met.add(node)
                prefixes.append(own[: prefix_length(len(own))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low), pa.array(fps, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "fp", "n", "columns"],
            )

    return work


def _pairs_of(group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that stand in the same run of equal ``group`` values."""
    rows = np.arange(len(group))
    for step in range(1, most):
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            return
        yield rows, rows + step


class _Product:
    """Partial counts of the pairs in a block of columns."""

    names = ("fa", "na", "fb", "nb", "c")

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, fa, na, fb, nb) -> None:
        keep = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)  # sizes allow the similarity
        keep &= (fa != fb) | (na != nb)
        fa, na, fb, nb = (v[keep] for v in (fa, na, fb, nb))
        turned = (fa > fb) | ((fa == fb) & (na > nb))
        self.held.append((
            np.where(turned, fb, fa), np.where(turned, nb, na), np.where(turned, fa, fb), np.where(turned, na, nb),
            np.ones(len(fa), dtype=np.int64),
        ))
        self.size += len(fa)
        if self.size > HELD_PAIRS:
            self._sum()

    def _sum(self) -> None:
        if not self.held:
            return
        fa, na, fb, nb, c = (np.concatenate(v) for v in zip(*self.held, strict=True))
        order = np.lexsort((nb, na, fb, fa))
        fa, na, fb, nb, c = (v[order] for v in (fa, na, fb, nb, c))
        new = np.ones(len(fa), dtype=bool)
        new[1:] = (fa[1:] != fa[:-1]) | (fb[1:] != fb[:-1]) | (na[1:] != na[:-1]) | (nb[1:] != nb[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(c, at) if len(at) else c
        self.held = [(fa[at], na[at], fb[at], nb[at], total)]
        self.size = len(at)

    def drain(self, all_: bool) -> Iterator[pa.RecordBatch]:
        """The sums, when they are many or nothing more comes."""
        if all_:
            self._sum()
        if self.held and (all_ or self.size > HELD_PAIRS // 2):
            self._sum()
            columns = self.held[0]
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[i : i + (1 << 16)]) for v in columns], list(self.names))
            self.held, self.size = [], 0


def _multiplying(hot: int):
    """Rows (h, fp, n) sorted by column h and node: partial pair counts.

    Columns of more than ``hot`` nodes only give each node's count of them, with b null;
    no more than ``hot`` rows of a column are held beyond a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, counts = _Product(), _Counts()
        carry: list[np.ndarray] | None = None
        hot_h = None

        def finish(h, f, n):
            """Whole columns: cold ones are multiplied, hot ones noted."""
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(h)))
            each = np.repeat(size, size)
            for i in np.flatnonzero(size > hot):
                counts.add(f[at[i] : at[i] + size[i]], n[at[i] : at[i] + size[i]])
            keep = (each > 1) & (each <= hot)
            h, f, n = h[keep], f[keep], n[keep]
            for a, b in _pairs_of(h, hot):
                product.add(f[a], n[a], f[b], n[b])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("h", "fp", "n")]
            if hot_h is not None:
                same = own[0] == hot_h
                if same.any():
                    counts.add(own[1][same], own[2][same])
                    own = [v[~same] for v in own]
                if not len(own[0]):
                    yield from counts.drain(False)
                    yield from product.drain(False)
                    continue
                hot_h = None
            if carry is not None:
                own = [np.concatenate(v) for v in zip(carry, own, strict=True)]
            h, f, n = own
            again = np.zeros(len(h), dtype=bool)
            again[1:] = (h[1:] == h[:-1]) & (f[1:] == f[:-1]) & (n[1:] == n[:-1])
            own = [v[~again] for v in own]
            last = int(np.searchsorted(own[0], own[0][-1], side="left"))
            finish(*[v[:last] for v in own])
            carry = [v[last:] for v in own]
            if len(carry[0]) > hot:
                hot_h = carry[0][0]
                counts.add(carry[1], carry[2])
                carry = None
            yield from counts.drain(False)
            yield from product.drain(False)
        if carry is not None:
            finish(*carry)
        yield from counts.drain(True)
        yield from product.drain(True)

    return run


class _Counts:
    """How many of each node's columns were left out."""

    def __init__(self):
        self.held: dict[tuple[int, int], int] = {}

    def add(self, f: np.ndarray, n: np.ndarray) -> None:
        for node in zip(f.tolist(), n.tolist(), strict=True):
            self.held[node] = self.held.get(node, 0) + 1

    def drain(self, all_: bool) -> Iterator[pa.RecordBatch]:
        if self.held and (all_ or len(self.held) > KEPT_SETS):
            nodes, c = list(self.held), list(self.held.values())
            none = pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in nodes]), pa.array([x[1] for x in nodes]), none, none, pa.array(c, pa.int64())],
                list(_Product.names),
            )
            self.held = {}


_LONG = T.LongType()
_PAIRS = T.StructType([T.StructField(c, _LONG) for c in _Product.names])


def _product(rows: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Pair counts, and how many columns of each node were left out."""
    out = written(
        rows.repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h", "fp", "n")
        .mapInArrow(_multiplying(hot), _PAIRS),
        "product",
    )
    pairs = out.filter("fb IS NOT NULL").groupBy("fa", "na", "fb", "nb").agg(F.sum("c").alias("c"))
    left_out = out.filter("fb IS NULL").groupBy(F.col("fa").alias("fp"), F.col("na").alias("n")).agg(
        F.sum("c").alias("hot")
    )
    return pairs, left_out


def _whole_sets(batch_texts: DataFrame) -> DataFrame:
    """Rows (h, fp, n) of every shingle of the nodes' texts."""

    def make():
        def work(batch: pa.RecordBatch):
            fp, n = batch.column("fp"), batch.column("n")
            for low, high, t in texts(batch.column("text")):
                sets = shingles(t)
                rows = pa.array(np.repeat(np.arange(low, high), [len(s) for s in sets]))
                h = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), fp.take(rows), n.take(rows)], ["h", "fp", "n"])

        return work

    return batch_texts.mapInArrow(
        per_batch(make), T.StructType([T.StructField(c, _LONG) for c in ("h", "fp", "n")])
    )


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each of the nodes (fp, n, doc_id): rows with another set are dropped."""

    def make():
        def work(batch: pa.RecordBatch):
            keep = []
            wanted = list(zip(batch.column("fp").to_pylist(), batch.column("n").to_pylist(), strict=True))
            for low, _, t in texts(batch.column("text")):
                keep += [wanted[low + i] == (fingerprint(s), len(s)) for i, s in enumerate(shingles(t))]
            yield batch.filter(pa.array(keep, pa.bool_()))

        return work

    own = docs.select(F.col("doc_id").alias("_id"), "text")
    joined = own.join(nodes, F.col("_id").eqNullSafe(F.col("doc_id"))).select("fp", "n", "text")
    return joined.mapInArrow(per_batch(make), joined.schema).dropDuplicates(["fp", "n"])


def _verified(pairs: DataFrame, node_texts: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough, by their texts."""
    a = node_texts.select(F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("text").alias("ta"))
    b = node_texts.select(F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("text").alias("tb"))
    joined = pairs.select("fa", "na", "fb", "nb").join(a, ["fa", "na"]).join(b, ["fb", "nb"]).select(
        "fa", "na", "fb", "nb", "ta", "tb"
    )

    def make():
        def work(batch: pa.RecordBatch):
            keep = []
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                own = [[s for _, _, t in texts(some.column(c)) for s in shingles(t)] for c in ("ta", "tb")]
                for x, y in zip(*own, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield batch.select(["fa", "na", "fb", "nb"]).filter(pa.array(keep, pa.bool_()))

        return work

    return joined.mapInArrow(per_batch(make), T.StructType([T.StructField(c, _LONG) for c in ("fa", "na", "fb", "nb")]))


def _node(fp: str, n: str) -> Column:
    return F.struct(F.col(fp).alias("fp"), F.col(n).alias("n"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes have different roots, so far."""
    a = roots.select(F.col("node.fp").alias("fa"), F.col("node.n").alias("na"), F.col("root").alias("ra"))
    b = roots.select(F.col("node.fp").alias("fb"), F.col("node.n").alias("nb"), F.col("root").alias("rb"))
    joined = pairs.join(a, ["fa", "na"], "left").join(b, ["fb", "nb"], "left")
    ra, rb = F.coalesce("ra", _node("fa", "na")), F.coalesce("rb", _node("fb", "nb"))
    return joined.filter(ra != rb).select("fa", "na", "fb", "nb")


def _first_choice(pairs: DataFrame) -> DataFrame:
    """Each node's pair with its least neighbour and with the one that shares most."""
    both = pairs.select("fa", "na", "fb", "nb", "c").unionByName(
        pairs.select(F.col("fb").alias("fa"), F.col("nb").alias("na"), F.col("fa").alias("fb"), F.col("na").alias("nb"), "c")
    )
    chosen = both.groupBy("fa", "na").agg(
        F.min(_node("fb", "nb")).alias("x"), F.max(F.struct("c", _node("fb", "nb").alias("y"))).alias("z")
    ).select("fa", "na", F.explode(F.array("x", "z.y")).alias("o"))
    a, b = _node("fa", "na"), F.col("o")
    return chosen.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().select(
        F.col("a.fp").alias("fa"), F.col("a.n").alias("na"), F.col("b.fp").alias("fb"), F.col("b.n").alias("nb")
    )


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(_node("fa", "na").alias("a"), _node("fb", "nb").alias("b"))


def nodes_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, the node (``fp``, ``n``) and its first columns, one row per document."""
    own = docs.select("doc_id", "text")
    return written(own.mapInArrow(per_batch(_hashing), _rows_schema(own.schema["doc_id"].dataType)), "nodes")


def _by_column(rows: DataFrame, columns: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (h, fp, n) joined with a table of columns; the rows of a column are salted by their node."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("fp", "n"), F.lit(SALTS)).cast("int"))
    return dealt.join(columns.select("*", salts), ["h", "_salt"], how).drop("_salt")


def _counted(sets: DataFrame, alone: bool = True) -> DataFrame:
    """Rows (h, fp, n) with how many rows their column has, as ``many``; without ``alone`` only if it has others."""
    shared = written(sets.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1"), "counts")
    counted = _by_column(sets, shared, "left" if alone else "inner")
    return counted.withColumn("many", F.coalesce("many", F.lit(1).cast("long")))


def link_nodes(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node that is linked, roots left out."""
    filled = hashed.filter("fp IS NOT NULL")
    members = filled.groupBy("fp", "n").agg(F.min("doc_id").alias("doc_id"))
    columns = filled.filter("columns IS NOT NULL").select("fp", "n", F.explode("columns").alias("h"))
    pairs, left_out = _product(columns)
    na, nb = F.col("na"), F.col("nb")
    rest = F.greatest(na - prefix_length(na), nb - prefix_length(nb))
    bound = _needed(na, nb) - rest - F.floor(F.greatest(na, nb) / TOLERATED)
    first = written(pairs.filter(F.col("c") >= bound), "pairs")
    anew = written(left_out.filter(F.col("hot") > F.floor(F.col("n") / TOLERATED)).select("fp", "n"), "anew")

    wanted = anew.unionByName(first.select(F.col("fa").alias("fp"), F.col("na").alias("n"))).unionByName(
        first.select(F.col("fb").alias("fp"), F.col("nb").alias("n"))
    ).distinct()
    node_texts = written(_texts_of(docs, members.join(wanted, ["fp", "n"])), "texts")

    # The nodes to be joined anew: whole sets, rarest columns first. Each text makes many rows,
    # so texts are dealt over all tasks first, however few files hold them.
    dealt = node_texts.join(anew, ["fp", "n"]).repartition(partitions(docs.sparkSession), "fp", "n")
    sets = _whole_sets(dealt)
    # A node has n columns; those that it has alone come first and need no row.
    ordered = _counted(sets, alone=False).groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("many", "h"))).alias("all"))
    first_ones = F.greatest(F.lit(0), F.floor(F.col("n") / 4) + 1 - (F.col("n") - F.size("all"))).cast("int")
    rare = written(
        ordered.select("fp", "n", F.explode(F.slice("all", 1, first_ones)).alias("one"))
        .select("fp", "n", "one.many", "one.h"),
        "rare",
    )
    again, _ = _product(rare.select("h", "fp", "n"))
    candidates = written(
        first.unionByName(again).unionByName(_with_hubs(rare))
        .groupBy("fa", "na", "fb", "nb").agg(F.max("c").alias("c")),
        "candidates",
    )
    links, roots = _linked([], candidates, node_texts)

    # Nodes of frequent columns that still hold different roots are multiplied in full.
    rooted = rare.withColumn("node", _node("fp", "n")).join(roots, "node", "left").withColumn(
        "root", F.xxhash64(F.coalesce("root", "node"))
    )
    mixed = rooted.filter(F.col("many") > HOT).groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    mixed = written(mixed.filter("x != y").select("h"), "mixed")
    open_nodes = written(_by_column(rooted, mixed, "left_semi").select("fp", "n").distinct(), "open")
    last = written(_row_blocks(rooted.join(open_nodes, ["fp", "n"]), open_nodes.count()), "pairs")
    return _linked(links, last, node_texts)[1]


def _row_blocks(rows: DataFrame, nodes: int) -> DataFrame:
    """Pairs of different roots whose counts reach their bound, from all columns at once.

    Rows (h, fp, n, root) are dealt to pairs of row blocks, so that a task has the whole
    counts of its pairs and hands on none that is discarded.
    """
    blocks = max(1, -(-nodes // ROW_BLOCK))
    own = F.pmod(F.xxhash64("fp", "n"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("h", "fp", "n", "root", own.alias("own"), other.alias("other"))
    keyed = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return keyed.repartition(partitions(rows.sparkSession), "i", "j").sortWithinPartitions("i", "j", "h").mapInArrow(
        _crossing, _PAIRS
    )


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair of blocks; holds the rows of one pair."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("i", "j", "own", "h", "fp", "n", "root")]
        change = np.ones(batch.num_rows + 1, dtype=bool)
        change[1:-1] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        at = np.flatnonzero(change)
        for a, b in zip(at, at[1:], strict=False):
            now = (columns[0][a], columns[1][a])
            if now != key:
                if held:
                    yield _block_pairs(key, held)
                key, held = now, []
            held.append([c[a:b] for c in columns[2:]])
    if held:
        yield _block_pairs(key, held)


def _block_pairs(key: tuple[int, int], held: list[list[np.ndarray]]) -> pa.RecordBatch:
    own, h, f, n, root = (np.concatenate(v) for v in zip(*held, strict=True))
    sides, local = [], np.zeros(len(h), dtype=np.int64)
    for block in sorted(set(key)):
        at = np.flatnonzero(own == block)
        nodes, index, back = np.unique(
            np.rec.fromarrays([f[at], n[at]], names="f,n"), return_index=True, return_inverse=True
        )
        local[at] = back
        sides.append((nodes["f"], nodes["n"], root[at][index]))
    (fa, na, ra), (fb, nb, rb) = sides[0], sides[-1]
    counts = np.zeros((len(fa), len(fb)), dtype=np.int32)
    edges = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(h)), strict=True):
        if b - a > 1:
            x = local[a:b][own[a:b] == key[0]]
            y = local[a:b][own[a:b] == key[1]]
            counts[np.ix_(x, y)] += 1
    size_a, size_b = na[:, None], nb[None, :]
    needed = -(-(size_a + size_b) * PERCENT // (100 + PERCENT))
    rest = np.maximum(size_a - size_a // 4 - 1, size_b - size_b // 4 - 1)
    keep = (counts >= np.maximum(needed - rest, 1)) & (ra[:, None] != rb[None, :])
    keep &= 4 * np.minimum(size_a, size_b) >= 3 * np.maximum(size_a, size_b)
    if key[0] == key[1]:
        keep = np.triu(keep, 1)
    x, y = np.nonzero(keep)
    turned = (fa[x] > fb[y]) | ((fa[x] == fb[y]) & (na[x] > nb[y]))
    columns = [
        np.where(turned, fb[y], fa[x]), np.where(turned, nb[y], na[x]), np.where(turned, fa[x], fb[y]),
        np.where(turned, na[x], nb[y]), counts[x, y].astype(np.int64),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_Product.names))


def _with_hubs(rare: DataFrame) -> DataFrame:
    """Pairs of each node with the hubs of its frequent columns."""
    hot = rare.filter(F.col("many") > HOT)
    weighed = hot.join(hot.groupBy("fp", "n").agg(F.count("*").alias("w")), ["fp", "n"])
    hubs = weighed.groupBy("h").agg(F.max(F.struct("w", "fp", "n")).alias("hub"))
    pairs = _by_column(hot, hubs).groupBy(_node("fp", "n").alias("x"), F.struct("hub.fp", "hub.n").alias("y")).agg(
        F.count("*").alias("c")
    )
    a, b = F.least("x", "y"), F.greatest("x", "y")
    sized = pairs.filter("x != y AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)").select(a.alias("a"), b.alias("b"), "c")
    return sized.select(
        F.col("a.fp").alias("fa"), F.col("a.n").alias("na"), F.col("b.fp").alias("fb"), F.col("b.n").alias("nb"), "c"
    )


def _linked(links: list[DataFrame], candidates: DataFrame, node_texts: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The links with those among the candidates, and the roots: a link within a component is not looked for."""
    links = [*links, written(_verified(_first_choice(candidates), node_texts), "links")]
    roots = _roots(links)
    links = [*links, written(_verified(_apart(candidates, roots), node_texts), "links")]
    return links, _roots(links)


def _roots(links: list[DataFrame]) -> DataFrame:
    edges = _edges(links[0])
    for own in links[1:]:
        edges = edges.unionByName(_edges(own))
    return graph.components(edges)


def join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document."""
    hashed = nodes_of(docs)
    roots = link_nodes(docs, hashed)
    members = hashed.filter("fp IS NOT NULL").groupBy("fp", "n").agg(F.min("doc_id").alias("least"))
    rooted = members.withColumn("node", _node("fp", "n")).join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    found = rooted.join(least, "root").select("fp", "n", "component_id", salts)
    # A class of copies may hold a third of all rows: its rows are salted.
    dealt = hashed.select("doc_id", "fp", "n", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    return dealt.join(found, ["fp", "n", "_salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _with_nodes(names: tuple[str, str]):
    def make():
        def work(batch: pa.RecordBatch):
            fps, sizes = [], []
            for _, _, t in texts(batch.column("text")):
                for own in shingles(t):
                    fps.append(fingerprint(own) if len(own) else None)
                    sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())], [*batch.schema.names, *names]
            )

        return work

    return make


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least ``doc_id``, with its own columns.

    Documents with an empty set are all kept; of repeated rows one is. An empty table stays
    empty, and columns of ``docs`` may have any names.
    """
    hashed = nodes_of(docs)
    roots = link_nodes(docs, hashed)
    members = hashed.filter("fp IS NOT NULL").groupBy("fp", "n").agg(F.min("doc_id").alias("least"))
    rooted = members.withColumn("node", _node("fp", "n")).join(roots, "node", "left")
    # Names that no column of the documents has, in any case.
    taken, mark = {name.lower() for name in docs.columns}, "_"
    while any(name.startswith(mark) for name in taken):
        mark += "_"
    keys = fp, n, id_ = f"{mark}fp", f"{mark}n", f"{mark}id"
    # Null ids come last: they name a document only where no other is.
    first = F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(first).select(
        F.col("first.node.fp").alias(fp), F.col("first.node.n").alias(n),
        F.coalesce(F.col("first.least").cast("string"), F.lit("")).alias(id_),
    )
    own = docs.mapInArrow(
        per_batch(_with_nodes((fp, n))),
        T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType()), T.StructField(n, T.LongType())]),
    )
    keyed = own.withColumn(id_, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = keyed.filter(F.col(n) > 0).join(kept, list(keys)).dropDuplicates(list(keys))
    return chosen.unionByName(keyed.filter(F.col(n) == 0)).select(*docs.columns)

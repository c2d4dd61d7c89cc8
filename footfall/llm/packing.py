"""Packing tokenised documents into sequences of fixed length.

Documents longer than a sequence are cut into whole sequences and a rest. How pieces go
together depends on their lengths alone, and there are at most as many lengths as a
sequence has tokens. So the plan is made on the counts by length: first the sets that
dominate every alternative are fixed for good (Martello and Toth's reduction), then what
is left is packed best-fit, longest first. The plan says for every run of ranks among
the pieces of one length which sequence and place they get; pieces take their rank from
a distributed numbering. No task or driver ever holds the pieces.

Null texts are empty documents (the end token alone). Repeated rows are packed each; among
equal rows it does not matter which one takes which place. An empty table packs nothing.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pooled import IdLists, distinct
from .store import partitions, per_batch, written
from .words import buffers

CAPACITY = 2048
END_ID = 0
#: Chunks of text whose ids a task keeps (some 200 bytes each), and the longest kept.
KEPT_CHUNKS = 1_000_000
KEPT_LENGTH = 48
#: What stands between chunks that are encoded together, and how many are.
MARK, MARKED = "0", 64


class ChunkTokens:
    """Ids of texts, made by the tokenizer once per distinct chunk between blanks.

    Where the tokenizer drops blanks and line ends and treats what stands between them alike
    wherever it stands, a text's ids are those of its chunks one after the other. Whether it
    does is tried out first; with another tokenizer every text is encoded as a whole.
    """

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The number of each known chunk, and its ids by that number.
        self.known: dict[str, int] = {}
        self.lists = IdLists(np.dtype("<u4"))
        #: A digit is a token of its own: many chunks are encoded as one text with it between.
        self.mark = self._ids(MARK)[0]
        probes = ["a", "Ab", "\u00e9\u2603", "x.,y", "<|a|>"]
        self.chunked = self._ids(MARK) == [self.mark] and all(
            self._ids(blank) == [] and self._ids(f"{p}{blank}{q}") == self._ids(p) + self._ids(q)
            for blank in (" ", "\n", " \n ") for p in probes for q in probes
        ) and all(self._ids(f"{p} {MARK} {q}") == self._ids(p) + [self.mark] + self._ids(q) for p in probes for q in probes)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(code.ids, dtype="<u4") for code in coded]

    def _learn(self, chunks: list[str]) -> None:
        """Numbers the chunks, which hold no mark, in their order."""
        groups = [chunks[i : i + MARKED] for i in range(0, len(chunks), MARKED)]
        coded = self.tokenizer.encode_batch_fast(
            [f" {MARK} ".join(group) + f" {MARK}" for group in groups], add_special_tokens=False
        )
        ids = np.fromiter(chain.from_iterable(code.ids for code in coded), dtype="<u4")
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(chunks):
            raise ValueError(f"{len(chunks)} chunks gave {len(marks)} marks")
        first = np.append(0, marks[:-1] + 1)
        numbers = self.lists.add(ids[ids != self.mark], first - np.arange(len(marks)), marks - first)
        self.known.update(zip(chunks, numbers.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.ids(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many there are before each text and in all."""
        if not self.chunked:
            coded = self._coded([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, dtype="<u4"), *coded]), np.cumsum([0, *map(len, coded)])
        chunks, ends = _chunks(texts)
        which, names = distinct(chunks)
        number = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(number < 0)
        if len(self.known) + len(missing) > self.kept:
            self.known, self.lists = {}, IdLists(np.dtype("<u4"))
            missing = np.arange(len(names))
        new = list(map(names.__getitem__, missing.tolist()))
        plain = [c for c in new if MARK not in c and len(c) <= KEPT_LENGTH]
        for i in range(0, len(plain), 4096):
            self._learn(plain[i : i + 4096])
        rest = [c for c in new if MARK in c and len(c) <= KEPT_LENGTH]
        if rest:
            self.known.update(zip(rest, self.lists.add_each(self._coded(rest)).tolist(), strict=True))
        kept = self.lists.state()
        own = {}
        if long := [c for c in new if len(c) > KEPT_LENGTH]:
            own = dict(zip(long, self.lists.add_each(self._coded(long)).tolist(), strict=True))
        number[missing] = [own[c] if c in own else self.known[c] for c in new]
        ids, bounds = self.lists.given(number[which])
        self.lists.back_to(kept)
        return ids, bounds[ends]


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between blanks and line ends in all texts; text ``i`` has ``ends[i]`` to ``ends[i + 1]``."""
    data, offsets = buffers(texts)
    offsets, data = offsets - offsets[0], data[offsets[0] : offsets[-1]]
    solid = (data != 0x20) & (data != 0x0A)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[offsets < len(data)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    before = np.append(0, np.cumsum(solid))
    chunks = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(before[np.append(starts, len(data))]), pa.py_buffer(data[solid])
    )
    return chunks, np.searchsorted(starts, offsets)


def _runs(offsets: np.ndarray, limit: int = 1 << 20):
    """Consecutive texts of ``limit`` bytes together, or one longer text."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1, begin + 1)
        yield begin, end
        begin = end


# A worker process serves many tasks: it reads a tokenizer once, and keeps what it learned,
# also while it serves other operators later: ``kept`` bounds what that may take.
_TOKENS: dict[tuple[str, int], ChunkTokens] = {}


def _tokens(path: str, kept: int) -> ChunkTokens:
    if (path, kept) not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path, kept] = ChunkTokens(path, kept)
    return _TOKENS[path, kept]


def _tokenising(path: str, capacity: int, with_ids: bool, kept: int):
    def make():
        tokens = _tokens(path, kept)

        def work(batch: pa.RecordBatch):
            text = batch.column("text")
            for low, high in _runs(buffers(text)[1]):
                ids, ends = tokens.ids(text.slice(low, high - low))
                ids, ends = np.insert(ids, ends[1:], END_ID), ends + np.arange(len(ends))
                size = np.diff(ends)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                bounds = np.append(ends[row] + start, len(ids))
                data, at = memoryview(ids.tobytes()), (4 * bounds).tolist()
                columns = [
                    batch.column("doc_id").take(pa.array(low + row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(np.diff(bounds)),
                    pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [*PIECE, "ids"][: len(columns)])

        return work

    return make


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, kept: int = KEPT_CHUNKS
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every whole text's pieces.

    ``with_ids`` adds their ``ids``. ``kept`` is how many chunks of text a worker remembers
    the ids of: fewer take less memory and more time, the pieces are the same.
    """
    own = docs.select("doc_id", "text")
    kinds = [own.schema["doc_id"].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType()]
    fields = [T.StructField(name, kind) for name, kind in zip(PIECE, kinds, strict=True)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return own.mapInArrow(per_batch(_tokenising(tokenizer_path, capacity, with_ids, kept)), T.StructType(fields))


class Plan:
    """Which sequence and place the pieces of each length get, by their rank.

    A row (size, rank, count, sequence, per, offset) says: of the pieces of ``size``, those
    with ranks from ``rank`` on, ``count`` of them, fill sequences from ``sequence`` on, ``per``
    in each, one after the other from ``offset``.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.total = dict(self.left)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def _put(self, size: int, count: int, sequence: int, per: int, offset: int) -> None:
        self.rows.append((size, self.total[size] - self.left[size], count, sequence, per, offset))
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]

    def _fix(self, sizes: list[int], times: int) -> None:
        """``times`` sequences that hold these sizes and never change again."""
        offset = 0
        first, self.sequences = self.sequences, self.sequences + times
        self.fixed += times
        if len(sizes) == 2 and sizes[0] == sizes[1]:
            self._put(sizes[0], 2 * times, first, 2, 0)
            return
        for size in sizes:
            self._put(size, times, first, 1, offset)
            offset += size

    def reduce(self) -> None:
        """Fixes sets that dominate all others for their largest piece, until none does.

        A set dominates if each alternative's companions can be replaced by the set's own:
        a companion that fills the rest exactly, no companion where none fits, the largest
        that fits where no two fit, or where no three fit and no two are larger together.
        """
        for size in sorted(self.left, reverse=True):
            rest = self.capacity - size
            if size in self.left and rest in self.left:
                times = self.left[size] // 2 if rest == size else min(self.left[size], self.left[rest])
                if times:
                    self._fix([size, rest], times)
        changed = True
        while changed:
            changed = False
            for size in sorted(self.left, reverse=True):
                while size in self.left:
                    companion = self._dominating(size)
                    if companion is None:
                        break
                    changed = True
                    if companion == 0:
                        self._fix([size], self.left[size])
                    elif companion == size:
                        self._fix([size, size], self.left[size] // 2)
                    else:
                        self._fix([size, companion], min(self.left[size], self.left[companion]))

    def _dominating(self, size: int) -> int | None:
        """The companion of a dominating set, 0 for none needed; None if no set dominates."""
        order = sorted(self.left)
        have = lambda s: self.left[s] - (s == size)
        small: list[int] = []
        for s in order:
            small += [s] * min(3 - len(small), have(s))
            if len(small) == 3:
                break
        room = self.capacity - size
        if not small or small[0] > room:
            return 0
        i = bisect_left(order, room + 1) - 1
        while have(order[i]) < 1:
            i -= 1
        best = order[i]
        if best == room or len(small) < 2 or small[0] + small[1] > room:
            return best
        if len(small) > 2 and sum(small) <= room:
            return None
        return best if best >= self._best_two(order[: i + 1], have, room) else None

    @staticmethod
    def _best_two(order: list[int], have, room: int) -> int:
        """The largest sum within ``room`` of two pieces."""
        low, high, best = 0, len(order) - 1, 0
        while low <= high:
            total = order[low] + order[high]
            if total > room:
                high -= 1
                continue
            if low != high and have(order[low]) and have(order[high]) or low == high and have(order[low]) > 1:
                best = max(best, total)
            low += 1
        return best

    def best_fit(self) -> None:
        """Packs what is left, longest first, each into the fullest sequence that has room."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
        rooms: list[int] = []

        def leave(room: int, first: int, many: int) -> None:
            if many and room:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((first, many))

        for size in sorted(self.left, reverse=True):
            while size in self.left:
                wanted = self.left[size]
                i = bisect_left(rooms, size)
                if i < len(rooms):
                    room = rooms[i]
                    first, many = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[i]
                else:
                    room, first = self.capacity, self.sequences
                    many = -(-wanted // (room // size))
                    self.sequences += many
                per, offset = room // size, self.capacity - room
                full = min(many, wanted // per)
                if full:
                    self._put(size, full * per, first, per, offset)
                    leave(room - per * size, first, full)
                rest = min(wanted - full * per, per) if full < many else 0
                if rest:
                    self._put(size, rest, first + full, rest, offset)
                    leave(room - rest * size, first + full, 1)
                leave(room, first + full + bool(rest), many - full - bool(rest))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    out = Plan(counts, capacity)
    out.reduce()
    out.best_fit()
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``cut`` has ``length`` of 1 to ``capacity``.

    ``cut`` is read three times; pass a written table.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity).rows
    # At most one row for each length and run of sequences: bounded by the capacity alone.
    steps = spark.createDataFrame(
        rows, "length long, _from long, _count long, _first long, _per long, _offset long"
    ).withColumn("_to", F.col("_from") + F.col("_count"))

    # Ranks within a length: dealt to salted groups first, as one length may hold most rows.
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*cut.columns), F.lit(partitions(spark))).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    order = [F.col(c) for c in cut.columns if c != "length"]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    placed = ranked.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    joined = placed.join(
        F.broadcast(steps.withColumnRenamed("length", "_size")),
        (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    )
    step = F.col("_rank") - F.col("_from")
    return joined.select(
        *cut.columns,
        (F.col("_first") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + step % F.col("_per") * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, kept: int = KEPT_CHUNKS
) -> DataFrame:
    """Every piece of every document with its checksum, sequence and place."""
    cut = written(pieces(docs, tokenizer_path, capacity, kept=kept), "pieces")
    return pack(cut, capacity)

"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda: best piece first, the leftmost among equals. A candidate
is skipped when a hash of the key, its place and its piece says so; the key is made of the
seed, the document and the unit's place in its text, so a document is always cut alike, and
each occurrence of a word on its own. Whatever is skipped, the pieces spell the text:
decoding is lossless. Without dropout the pieces are those of the library.

Whether a candidate is skipped is asked when its turn comes, so a merging is told by the
answers on its way. It is kept with them and holds for every occurrence that gets the same
ones; an occurrence that parts from it goes on at the merging kept for the first answer in
which they differ, or is merged anew.

Characters without a piece become bytes; so does the library's own mark for blanks where a
text holds it, which would else come back as a blank. Null texts have null ids and decode
to null, empty ones have none. A text is encoded whole in units that no piece crosses: a
run of blanks with what follows it, and line breaks. Repeated rows are encoded each alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pooled import Grown, IdLists, distinct
from .store import per_batch
from .words import buffers, mix

DROPOUT = 0.1
SEED = 1
#: Mergings that a worker keeps, and the candidates that a kept one met, at most.
KEPT_UNITS = 400_000
MET = 32
#: Units up to this length are merged side by side, and kept.
SHORT = 40
RUN_BYTES = 1 << 20
SLOT_BITS = 19
#: Units of like length are merged together, this many at most.
CLASSES = np.array([5, 7, 9, 11, 13, 16, 20, 28])
COLUMNS = 4096
FEW = 256
DECODED_ROWS = 256
MARK = "▁"
_NONE = np.int64(1) << 40


class Pieces:
    """The model's pieces, their merges and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        whole = {name: i for i, name in enumerate(names) if not special[i] and not byte[i]}
        self.bytes = [
            bytes([int(name[3:5], 16)]) if byte[i] else b"" if special[i] else name.replace(MARK, " ").encode()
            for i, name in enumerate(names)
        ]
        self.byte_ids = {self.bytes[i][0]: i for i in range(size) if byte[i]}
        self.chars = {(" " if name == MARK else name): i for name, i in whole.items() if len(name) == 1}
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        self.char_ids[[ord(c) for c in self.chars]] = list(self.chars.values())
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = [
            (whole[name[:cut]] << 20 | whole[name[cut:]], i)
            for name, i in whole.items()
            for cut in range(1, len(name))
            if name[:cut] in whole and name[cut:] in whole
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_ids = np.array([i for _, i in pairs], dtype=np.int64)
        self.merges = dict(pairs)
        # Where a pair is found by its hash; of pairs that share a slot all but one are searched for.
        slots = self._slot(self.pair_keys)
        self.at_slot = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.shared = np.zeros(1 << SLOT_BITS, dtype=bool)
        held, first, many = np.unique(slots, return_index=True, return_counts=True)
        self.at_slot[held], self.shared[held] = first, many > 1
        # A line break without a piece can be no part of one: texts may be cut there.
        self.cut_at_breaks = "\n" not in self.chars
        breaks = r"\n" if self.cut_at_breaks else ""
        self.units = re.compile(rf" *[^ {breaks}]+| +" + (r"|\n+" if breaks else "")).findall

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """What ``units`` finds in all texts, a blank before each that is not empty.

        Those of text ``i`` are at ``ends[i]`` to ``ends[i + 1]``, the second result.
        """
        data, offsets = buffers(texts)
        size = np.diff(offsets)
        full = size > 0
        data = np.insert(data[offsets[0] : offsets[-1]], (offsets[:-1] - offsets[0])[full], 0x20)
        bounds = np.append(0, np.cumsum(size + full))
        first = np.ones(len(data), dtype=bool)
        blank = data == 0x20
        if self.cut_at_breaks:
            line = data == 0x0A
            first[1:] = blank[1:] & ~blank[:-1] | line[1:] & ~line[:-1] | line[:-1] & ~line[1:]
        else:
            first[1:] = blank[1:] & ~blank[:-1]
        first[bounds[:-1][full]] = True
        starts = np.flatnonzero(first)
        units = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)
        )
        return units, np.searchsorted(starts, bounds)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair; -1 where there is none."""
        key = left << 20 | right  # negative if one of them is
        slot = self._slot(key)
        at = self.at_slot[slot]
        found = self.pair_keys[at] == key
        rest = np.flatnonzero(~found & self.shared[slot])
        if len(rest):
            at[rest] = np.minimum(np.searchsorted(self.pair_keys, key[rest]), len(self.pair_keys) - 1)
            found[rest] = self.pair_keys[at[rest]] == key[rest]
        return np.where(found, self.pair_ids[at], -1)

    def spelled(self, ids: list[int], places: list[int], unit: str) -> list[int]:
        """The ids with characters that have no piece (-1) as bytes."""
        out: list[int] = []
        for i, place in zip(ids, places, strict=True):
            out += [i] if i >= 0 else [self.byte_ids[b] for b in unit[place].encode()]
        return out


def places_of(start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Hashes of the candidates that make ``piece`` of the characters [start, end)."""
    return mix(
        (start.astype(np.uint64) << np.uint64(42)) | (end.astype(np.uint64) << np.uint64(20)) | piece.astype(np.uint64)
    )


def skipped(key: np.ndarray, places: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidates are skipped."""
    return mix(places ^ key) >> np.uint64(11) < np.uint64(int(dropout * (1 << 53)))


def keys_of(documents: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(documents.astype(np.uint64) + np.uint64(1)) ^ np.uint64(seed))


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit ids."""
    return np.array(ids, dtype="<i4").tobytes()


def merge_classes(
    pieces: Pieces, units: list[str], keys: np.ndarray, dropout: float, met: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of many short units, and where each unit's begin among them and how many they are.

    ``met`` gets unit, place and whether it is skipped of the candidates whose turn came.
    """
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    points = pieces.char_ids[np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")]
    begin = np.cumsum(lengths) - lengths
    kind = np.searchsorted(CLASSES, lengths) if len(units) > FEW else np.zeros(len(units), dtype=np.int64)
    done: list = []
    for k in np.flatnonzero(np.bincount(kind)).tolist():
        own = np.flatnonzero(kind == k)
        for i in range(0, len(own), COLUMNS):
            some = own[i : i + COLUMNS]
            _merge_columns(pieces, some, lengths[some], begin[some], points, keys, dropout, met, done)
    unit, many, ids, start = (np.concatenate(v) for v in zip(*done, strict=True))
    first, count = np.empty(len(units), dtype=np.int64), np.empty(len(units), dtype=np.int64)
    first[unit], count[unit] = np.cumsum(many) - many, many
    strange = np.flatnonzero(ids < 0)
    if len(strange):
        more, size = [ids], len(ids)
        for i in np.unique(np.repeat(unit, many)[strange]).tolist():
            own = slice(first[i], first[i] + count[i])
            spelled = pieces.spelled(ids[own].tolist(), start[own].tolist(), units[i])
            first[i], count[i] = size, len(spelled)
            size += len(spelled)
            more.append(np.array(spelled, dtype=np.int32))
        ids = np.concatenate(more)
    return ids, first, count


def _merge_columns(pieces, unit, lengths, begin, points, keys, dropout, met, done) -> None:
    """Merges units of like length: a column for each, a row for each place in it.

    Each round takes the best candidate of every unit. ``done`` gets units, how many symbols
    each has, and these symbols' ids and places, unit by unit.
    """
    rows, m = int(lengths.max()), len(unit)
    row = np.arange(rows + 1)[:, None]
    inside = row < lengths
    ids = np.full((rows + 1, m), -1, dtype=np.int64)
    ids[inside] = points[(begin + row)[inside]]
    end = np.where(inside, row + 1, 0)  # where the symbol that begins here ends; 0 where none begins
    left = np.repeat(row - 1, m, axis=1)  # where the symbol before it begins
    made = pieces.merged(ids[:-1].ravel(), ids[1:].ravel()).reshape(rows, m)
    order = np.where(made >= 0, pieces.rank[made] << 16 | row[:-1], _NONE)
    col = np.arange(m)

    def leave(gone: np.ndarray) -> None:
        symbols = np.take(end, gone, axis=1).T
        which, start = np.nonzero(symbols)
        done.append((unit[gone], np.bincount(which, minlength=len(gone)), ids[start, gone[which]].astype(np.int32), start))

    while True:
        best = order.min(axis=0)
        live = best < _NONE
        here = np.flatnonzero(live)
        if len(here) < m * 0.7:
            leave(np.flatnonzero(~live))
            if not len(here):
                return
            ids, end, left, made, order = (np.take(v, here, axis=1) for v in (ids, end, left, made, order))
            unit, best, m, here = unit[here], best[here], len(here), col[: len(here)]
        elif len(here) < m:
            best = best[here]
        ids_, end_, left_, made_, order_ = (v.reshape(-1) for v in (ids, end, left, made, order))
        start = best & 0xFFFF
        at = start * m + here
        second = end_[at] * m + here
        stop, piece = end_[second], made_[at]
        order_[at] = _NONE
        if dropout > 0:
            places = places_of(start, stop, piece)
            drop = skipped(keys[unit[here]], places, dropout)
            if met is not None:
                met.append((unit[here], places, drop))
            keep = np.flatnonzero(~drop)
            start, at, second, stop, piece, here = (v[keep] for v in (start, at, second, stop, piece, here))
        order_[second[second < rows * m]] = _NONE
        ids_[at], end_[at], end_[second] = piece, stop, 0
        after = stop * m + here
        left_[after] = start
        before = left_[at]
        some = np.flatnonzero(before >= 0)
        before = before[some] * m + here[some]
        changed = np.concatenate([at, before])
        new = pieces.merged(ids_[changed], np.concatenate([ids_[after], piece[some]]))
        made_[changed] = new
        order_[changed] = np.where(new >= 0, pieces.rank[new] << 16 | changed // m, _NONE)


def merge_side_by_side(
    pieces: Pieces, units: list[str], keys: np.ndarray, dropout: float, met: list | None = None
) -> list[bytes]:
    """Packed ids of many short units; ``met`` as in ``merge_classes``."""
    ids, first, count = merge_classes(pieces, units, keys, dropout, met)
    return [packed(ids[a : a + n]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]


def merge_agenda(pieces: Pieces, unit: str, key: int, dropout: float) -> bytes:
    """Packed ids of one unit of any length, by an agenda of candidates."""
    ids = [pieces.chars.get(c, -1) for c in unit]
    right = list(range(1, len(ids) + 1))  # where the symbol that begins here ends
    left = list(range(-1, len(ids) - 1))  # where the symbol before it begins
    agenda: list[tuple[int, int, int, int]] = []
    one = np.array([key], dtype=np.uint64)

    def suggest(a: int) -> None:
        b = right[a] if a >= 0 else len(ids)
        if b >= len(ids) or ids[a] < 0 or ids[b] < 0:
            return
        piece = pieces.merges.get(ids[a] << 20 | ids[b])
        if piece is not None and not (
            dropout > 0
            and skipped(one, places_of(np.array([a]), np.array([right[b]]), np.array([piece])), dropout)[0]
        ):
            heapq.heappush(agenda, (int(pieces.rank[piece]), a, right[b], piece))

    for a in range(len(ids)):
        suggest(a)
    gone = [False] * len(ids)
    while agenda:
        _, a, end, piece = heapq.heappop(agenda)
        if gone[a] or right[a] >= len(ids) or right[right[a]] != end or pieces.merges.get(ids[a] << 20 | ids[right[a]]) != piece:
            continue
        b = right[a]
        ids[a], right[a], gone[b] = piece, end, True
        if end < len(ids):
            left[end] = a
        suggest(a)
        if left[a] >= 0:
            suggest(left[a])
    alive = [i for i in range(len(ids)) if not gone[i]]
    return packed(pieces.spelled([ids[i] for i in alive], alive, unit))


class Mergings:
    """Mergings that were done: what each gave, the candidates it met and which it skipped."""

    def __init__(self, pieces: Pieces, dropout: float):
        self.pieces, self.dropout = pieces, dropout
        self.of_unit: dict[str, int] = {}
        #: By merging and the first candidate that an occurrence treats otherwise: one that does too.
        self.nearer: dict[int, int] = {}
        self.ids, self.places = IdLists(np.int32), Grown(np.uint64)
        self.first, self.count, self.skips = Grown(np.int64), Grown(np.int64), Grown(np.int64)

    def do(self, units: list[str], keys: np.ndarray) -> np.ndarray:
        """Merges the units and returns the numbers of their mergings.

        One that met more than ``MET`` candidates has a count of -1.
        """
        met: list = []
        numbers = self.ids.add(*merge_classes(self.pieces, units, keys, self.dropout, met))
        unit, places, drop = (np.concatenate(v) for v in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 3
        count = np.bincount(unit, minlength=len(units))
        order = np.argsort(unit, kind="stable")
        many = count > MET
        if many.any():
            order = order[~many[unit[order]]]
        unit, places, drop = unit[order], places[order], drop[order]
        count[many] = 0
        first = np.cumsum(count) - count
        bits = drop.astype(np.int64) << (np.arange(len(unit)) - first[unit])
        sums = np.append(0, np.cumsum(bits))
        self.first.add(self.places.size + first)
        self.skips.add(sums[first + count] - sums[first])
        self.places.add(places.astype(np.uint64))
        self.count.add(np.where(many, -1, count))
        return numbers

    def skipped_by(self, keys: np.ndarray, mergings: np.ndarray) -> np.ndarray:
        """Which of its merging's candidates each occurrence skips, as bits."""
        count = self.count.held[mergings]
        ends = np.cumsum(count)
        first = ends - count
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(first, count)
        drop = skipped(
            np.repeat(keys, count), self.places.held[place + np.repeat(self.first.held[mergings], count)], self.dropout
        )
        sums = np.append(0, np.cumsum(drop.astype(np.int64) << place))
        return sums[ends] - sums[first]


class Encoder:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces = Pieces(path)
        self.dropout, self.seed = dropout, seed
        self.known = Mergings(self.pieces, dropout)

    def encode(self, texts: list[str], documents: Iterable[int]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; the documents are told apart by the numbers."""
        ids, ends = self.ids(pa.array(texts, pa.large_string()), np.array(documents, dtype=np.int64))
        return [packed(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def ids(self, texts: pa.Array, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many there are before each text and in all."""
        units, ends = self.pieces.split(texts)
        size = np.diff(ends)
        keys = np.repeat(keys_of(documents, self.seed), size)
        keys = mix(keys + (np.arange(len(units)) - np.repeat(ends[:-1], size)).astype(np.uint64))
        if not len(units):
            return np.zeros(0, dtype=np.int32), np.zeros(len(ends), dtype=np.int64)
        ids, bounds = self._merged(units, keys)
        return ids, bounds[ends]

    def _merged(self, units: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences of units, each under its own key, and their bounds."""
        if len(self.known.ids) > KEPT_UNITS:
            self.known = Mergings(self.pieces, self.dropout)
        known = self.known
        name, names = distinct(units)
        merging = np.fromiter(map(known.of_unit.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(merging < 0)
        new = list(map(names.__getitem__, missing.tolist()))
        short = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) <= SHORT
        if short.any():
            # Any occurrence of a unit may stand for it: those that skip others go on from there.
            one = np.empty(len(names), dtype=np.int64)
            one[name] = np.arange(len(name))
            new, lost = list(compress(new, short.tolist())), missing[short]
            merging[lost] = known.do(new, keys[one[lost]])
            known.of_unit.update(zip(new, merging[lost].tolist(), strict=True))
        merging = merging[name]
        at = np.flatnonzero(merging >= 0)
        alone = []  # what met too many candidates to be kept
        while len(at):
            full = known.count.held[merging[at]] < 0
            if full.any():
                alone.append(at[full])
                at = at[~full]
            differ = known.skipped_by(keys[at], merging[at]) ^ known.skips.held[merging[at]]
            some = np.flatnonzero(differ)
            at, differ = at[some], differ[some]
            way = merging[at] << MET | differ & -differ
            nearer = np.fromiter(map(known.nearer.get, way.tolist(), repeat(-1)), dtype=np.int64, count=len(at))
            lost = np.flatnonzero(nearer < 0)
            if len(lost):
                ways, one, back = np.unique(way[lost], return_index=True, return_inverse=True)
                one = at[lost[one]]
                done = known.do(list(map(names.__getitem__, name[one].tolist())), keys[one])
                known.nearer.update(zip(ways.tolist(), done.tolist(), strict=True))
                nearer[lost] = done[back]
            merging[at] = nearer
        kept = known.ids.state()
        rest = np.concatenate(alone) if alone else np.zeros(0, dtype=np.int64)
        if len(rest):
            merging[rest] = known.ids.add(
                *merge_classes(self.pieces, [names[i] for i in name[rest].tolist()], keys[rest], self.dropout)
            )
        long = np.flatnonzero(merging < 0)
        if len(long):
            merging[long] = known.ids.add_each([
                np.frombuffer(merge_agenda(self.pieces, names[i], int(k), self.dropout), dtype="<i4")
                for i, k in zip(name[long].tolist(), keys[long].tolist(), strict=True)
            ])
        found = known.ids.given(merging)
        known.ids.back_to(kept)
        return found


# A worker process serves many tasks: it builds the tables of a model once and keeps its mergings.
_ENCODERS: dict[tuple[str, float, int], Encoder] = {}


def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    if (path, dropout, seed) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, dropout, seed] = Encoder(path, dropout, seed)
    return _ENCODERS[path, dropout, seed]


def _spelled(table: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The texts that the ids spell; ``table`` has the bytes of each piece."""
    bounds = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
    taken = table.take(ids.flatten()).cast(pa.large_binary())
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[bounds].tolist()
    data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return pa.array(
        [
            data[a:b].removeprefix(b" ").decode("utf-8", "replace") if valid else None
            for a, b, valid in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)
        ],
        pa.string(),
    )


def encode(
    docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, decoded: str | None = None
) -> DataFrame:
    """``doc_id``, ``text`` and its ``ids``, and the text that these spell as ``decoded``, if named."""
    own = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_document"))

    def make():
        encoder = _encoder(path, dropout, seed)
        table = pa.array(encoder.pieces.bytes, pa.binary())

        def work(batch: pa.RecordBatch):
            _, sizes = buffers(batch.column("text"))
            low = 0
            while low < batch.num_rows:
                end = int(np.searchsorted(sizes, sizes[low] + RUN_BYTES, side="right")) - 1
                some = batch.slice(low, max(end, low + 1) - low)
                low += some.num_rows
                text = some.column("text")
                values, ends = encoder.ids(text, some.column("_document").to_numpy())
                null = text.is_null()
                columns = [
                    some.column("doc_id"), text,
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=null),
                ]
                if decoded:
                    columns.append(_spelled(table, columns[2]))
                yield pa.RecordBatch.from_arrays(columns, fields)

        return work

    fields = ["doc_id", "text", "ids", *([decoded] if decoded else [])]
    schema = [own.schema["doc_id"], own.schema["text"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema += [T.StructField(decoded, T.StringType())] if decoded else []
    return own.mapInArrow(per_batch(make), T.StructType(schema))


def decode(encoded: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """All columns and the text that ``ids`` spell, as ``name``."""

    def make():
        table = pa.array(Pieces(path).bytes, pa.binary())

        def work(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, DECODED_ROWS):
                some = batch.slice(i, DECODED_ROWS)
                ids = some.column(some.schema.get_field_index("ids"))
                yield pa.RecordBatch.from_arrays([*some.columns, _spelled(table, ids)], [*some.schema.names, name])

        return work

    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    return encoded.mapInArrow(per_batch(make), schema)

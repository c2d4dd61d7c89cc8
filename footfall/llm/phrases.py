"""Phrases whose words occur together, counted on a prefix-free parsing of the corpus.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces
into words at blanks. A window of words whose hash falls into one class in ``MODULUS``
triggers a chunk; a chunk runs from its trigger to the end of the next one, so that
neighbours overlap by a window and equal passages give equal chunks wherever they stand.
Distinct chunks with their frequency are the dictionary. All counting works on distinct
chunks, weighted by frequency: a chunk counts the runs of words that begin before its last
window, so each run of at most a window and a word is counted by exactly one chunk.

Words are counted first, then pairs of frequent words, triples of frequent pairs, and runs
of more words whose triples are frequent, all by 64-bit hashes of language and words. What
is frequent is marked in bitmaps of fixed size; a false mark only lets more runs be counted.
The dictionary is dealt into parts, and a frequent run's text is read from the first part
that has it. Counts are whole numbers, scores decimals of 38 digits. Runs that share a hash
would be counted as one; with d distinct runs a phrase meets another by a chance of d in
2**64.

Null texts are empty, a null language is ``und``. Repeated rows count each. Texts longer
than ``SEGMENT`` bytes are read in segments that end at a separator, where no phrase goes
on; a run of bytes without one costs some 40 bytes of memory per byte. Equal scores go by
count, then by the phrase's bytes. Other columns are not read. An empty table, or one
without frequent pairs, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import Texts, buffers, mix, texts

#: One window in so many begins a chunk.
MODULUS = 32
#: Bits of the bitmap of frequent words or pairs (8 MiB).
BITS = 1 << 26
#: Bytes of a text, and of chunks, that are worked on at once.
SEGMENT, COUNTED = 1 << 20, 4 << 20
#: Keys whose counts a task sums before it passes them on.
KEYS = 1 << 20
#: Runs of up to so many words are marked, each size before the next one is counted.
MARKED = 3
#: Parts of the dictionary; the text of a phrase is taken from the first part that has it.
PARTS = 1 << 12
#: Parts of a language whose best phrases are found apart.
SALTS = 16

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[0x09] = 0x20
_BREAK = 0x0A
_PLAIN[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK


def _segments(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts cut behind a separator where they are longer than ``limit``, and whose they are."""
    long_ = np.flatnonzero(np.diff(offsets) > limit)
    cuts, owners = [offsets], [np.arange(len(offsets) - 1)]
    for i in long_.tolist():
        places = np.flatnonzero(data[offsets[i] : offsets[i + 1]] == _BREAK) + offsets[i] + 1
        # The last separator of each stretch of ``limit`` bytes.
        last = np.flatnonzero(np.diff((places - offsets[i]) // limit, append=-1))
        own = places[last][places[last] < offsets[i + 1]]
        cuts.append(own)
        owners.append(np.full(len(own), i))
    order = np.argsort(np.concatenate([c[:-1] if j == 0 else c for j, c in enumerate(cuts)]), kind="stable")
    starts = np.concatenate([offsets[:-1], *cuts[1:]])[order]
    return np.append(starts, offsets[-1]), np.concatenate(owners)[order]


def chunked(column: pa.Array, overlap: int, modulus: int, limit: int = SEGMENT) -> Iterator[tuple[int, int, bytes]]:
    """Row, number of own words and bytes of every chunk of every text.

    Words of a chunk are followed by a blank, or by a line end where a piece ends.
    """
    data, offsets = buffers(column)
    data = _PLAIN[data[: offsets[-1]] if len(offsets) else data]
    offsets, owners = _segments(data, offsets, limit)
    row = 0
    while row < len(owners):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(len(owners), max(end, row + 1))
        own = Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        for text, words, chunk in _parse(own, overlap, modulus):
            yield int(owners[row + text]), words, chunk
        row = end


def _parse(own: Texts, overlap: int, modulus: int) -> Iterator[tuple[int, int, bytes]]:
    starts, ends, owner = own.starts, own.ends, own.owners()
    if not len(starts):
        return
    # One byte between words of a text: a line end if any separator stands there.
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    breaks = np.concatenate([[0], np.cumsum(own.data == _BREAK)])
    plain, keep = own.data.copy(), own.solid.copy()
    plain[ends[inner]] = np.where(breaks[starts[inner + 1]] > breaks[ends[inner]], _BREAK, 0x20)
    keep[ends[inner]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    blob = plain[keep].tobytes()
    at, hashes = own.windows(own.hashes(), overlap)
    begins = np.unique(np.concatenate([own.first[:-1][own.counts > 0], at[hashes % np.uint64(modulus) == 0]]))
    last = own.first[1:][owner[begins]]
    following = np.minimum(np.append(begins[1:], len(starts)), last)
    final = np.minimum(following + overlap, last) - 1
    yield from zip(
        owner[begins].tolist(), (following - begins).tolist(),
        map(blob.__getitem__, map(slice, place[starts[begins]].tolist(), place[ends[final]].tolist())),
        strict=True,
    )


def dictionary(docs: DataFrame, longest: int = 5, modulus: int = MODULUS) -> DataFrame:
    """``lang``, ``chunk``, ``own`` (words that begin runs in it) and ``many`` (how often it occurs).

    ``part`` numbers the parts into which the dictionary is dealt by hash.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            size, langs = 0, batch.column("lang").to_pylist()
            for row, words, chunk in chunked(batch.column("text"), longest - 1, modulus):
                key = (langs[row], words, chunk)
                if key not in counts:
                    counts[key] = 0
                    size += len(chunk)
                counts[key] += 1
                if size > COUNTED:
                    yield emitted(counts)
                    counts, size = {}, 0
            yield emitted(counts)

    def emitted(counts: dict[tuple, int]) -> pa.RecordBatch:
        langs, words, chunks = zip(*counts, strict=True) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()),
             pa.array(words, pa.int64()), pa.array(list(counts.values()), pa.int64())],
            ["lang", "chunk", "own", "many"],
        )

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parsed = own.mapInArrow(parse, "lang string, chunk string, own long, many long")
    distinct = parsed.groupBy("lang", "chunk", "own").agg(F.sum("many").alias("many"))
    return distinct.withColumn("part", F.pmod(F.xxhash64("chunk", "own"), F.lit(PARTS)))


class Bitmap:
    """Which 64-bit keys are marked by their first bits; other keys may seem to be."""

    SHIFT = 64 - (BITS.bit_length() - 1)

    def __init__(self, slots: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(BITS // 64, dtype=np.uint64)
        self.words[slots] = bits.astype(np.int64).view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(self.SHIFT)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class _Runs:
    """Runs of words in some chunks: keys by language and words, and where they may begin."""

    def __init__(self, own: Texts, langs: np.ndarray):
        self.own = own
        self.hashes = own.hashes()
        owner = own.owners()
        same = np.zeros(len(self.hashes), dtype=bool)
        same[:-1] = owner[1:] == owner[:-1]
        gap = own.ends[same]
        #: Whether the next word follows in the same piece.
        self.joined = same
        self.joined[np.flatnonzero(same)] = own.data[gap] == 0x20
        self.owner = owner
        self.seed = langs[owner]

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        out = mix(self.hashes[at] ^ self.seed[at])
        for j in range(1, size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[at + j])
        return out


def _language_keys(column: pa.Array) -> np.ndarray:
    """A 64-bit number of each row's language."""
    coded = column.dictionary_encode()
    own = Texts(*buffers(coded.dictionary))
    whole = own.spans(own.offsets[:-1], own.offsets[1:]) if len(own.offsets) > 1 else np.zeros(0, np.uint64)
    # Unlike the hash of the same word, or "de" in texts of "es" would be "es" in texts of "de".
    return mix(whole * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))[coded.indices.to_numpy()]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes())
    ).cast(pa.string())


def _chains(found: _Runs, marks: list[Bitmap], longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every size, where runs of as many words begin whose marked parts are all frequent.

    ``marks`` has the bitmaps of single words, pairs and so on, as far as they are known.
    """
    fits = np.ones(len(found.hashes), dtype=bool)
    for size in range(1, longest + 1):
        if size > 1:
            # A run longer by a word: it and the run that begins a word later both fit.
            fits = fits & found.joined if size == 2 else fits.copy()
            fits[:-1] &= follow[1:]
            fits[-1:] = False
        if size <= len(marks):
            at = np.flatnonzero(fits)
            fits[at] = marks[size - 1].has(found.keys(at, size))
        yield size, fits
        follow = fits


def counted(batch: pa.RecordBatch, sizes: range, marks: list[Bitmap], owners: Bitmap | None) -> Iterator[pa.RecordBatch]:
    """Runs of ``sizes`` words in chunks: their keys with count and first part; with ``owners`` their texts.

    Texts are those of the runs that ``owners`` marks for the chunk's part.
    """
    seeds, langs = _language_keys(batch.column("lang")), batch.column("lang")
    own_words, many, part = (batch.column(n).to_numpy() for n in ("own", "many", "part"))
    for low, high, own in texts(batch.column("chunk"), COUNTED):
        found = _Runs(own, seeds[low:high])
        begins = np.arange(len(found.hashes)) - own.first[found.owner] < own_words[low:high][found.owner]
        for size, fits in _chains(found, marks, max(sizes)):
            if size not in sizes:
                continue
            at = np.flatnonzero(fits & begins)
            keys, rows = found.keys(at, size), found.owner[at]
            if owners is None:
                yield _by_key(keys.view(np.int64), np.full(len(at), size), many[low:high][rows], part[low:high][rows])
                continue
            mine = np.flatnonzero(owners.has(_owned(keys, part[low:high][rows])))
            _, first = np.unique(keys[mine], return_index=True)
            one = at[mine[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[mine[first]].view(np.int64)), langs.slice(low, high - low).take(pa.array(found.owner[one])),
                 _strings(own.data, own.starts[one], own.ends[one + size - 1])],
                ["key", "lang", "phrase"],
            )


def _owned(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """One number for a key and a part."""
    return mix(keys ^ (parts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _by_key(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Each key once, with the sum of its counts and its first part."""
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    sums, least = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys):
        sums, least = np.add.reduceat(counts[order], firsts), np.minimum.reduceat(parts[order], firsts)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[firsts]), pa.array(sizes[order[firsts]].astype(np.int32)), pa.array(sums), pa.array(least.astype(np.int32))],
        ["key", "size", "n", "part"],
    )


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = _one(parts)
    return _by_key(*(whole.column(n).to_numpy() for n in ("key", "size", "n", "part")))


def _combined(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Counts summed by key while there are at most ``most`` keys or twice as many rows."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows > 2 * most:
            held = [_merged(held)]
            rows = held[0].num_rows
            if rows > most:
                yield held[0]
                held, rows = [], 0
    if rows:
        yield _merged(held)


def _runs_of(chunks: DataFrame, sizes: range, marks: list[Broadcast], owners: Broadcast | None = None) -> DataFrame:
    """Partial counts ``key``, ``size``, ``n``, ``part`` of runs of ``sizes`` words; with ``owners`` their texts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [m.value for m in marks], owners and owners.value
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > COUNTED:
                yield from counted(_one(held), sizes, *known)
                held, size = [], 0
        if held:
            yield from counted(_one(held), sizes, *known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parts(batches) if owners else _combined(parts(batches), KEYS)

    return chunks.mapInArrow(count, "key long, lang string, phrase string" if owners else "key long, size int, n long, part int")


def _often(runs: DataFrame, least: int) -> DataFrame:
    """``key``, ``size``, ``n`` and ``part`` of the runs found ``least`` times."""
    summed = runs.groupBy("key").agg(F.first("size").alias("size"), F.sum("n").alias("n"), F.min("part").alias("part"))
    return written(summed.filter(F.col("n") >= least), "often")


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _marks(often: DataFrame, owners: bool = False) -> Broadcast:
    """The bitmap of the keys, or of each key with its first part, on all executors."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            at = (_owned(keys, batch.column("part").to_numpy()) if owners else keys) >> np.uint64(Bitmap.SHIFT)
            bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["slot", "bits"])

    # At most BITS / 64 rows of two numbers, whatever the corpus.
    placed = often.select("key", "part").mapInArrow(mark, "slot long, bits long")
    rows = placed.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    made = Bitmap(rows.column("slot").to_numpy(), rows.column("bits").to_numpy())
    return often.sparkSession.sparkContext.broadcast(made)


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = frequent.filter("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", F.col("n").alias("a"), "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    part = lambda side, name: frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    exact = lambda *names: " * ".join(f"CAST({n} AS DECIMAL(38,0))" for n in names)
    joined = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr(f"({exact('1000', 'a', 'n')}) div ({exact('l', 'r')})").cast("long").alias("score")
    lowest = joined.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def _maximal(scored: DataFrame) -> DataFrame:
    """Without phrases that never occur outside a longer one.

    What lies between such a phrase and the longer one is as frequent, and a candidate too,
    so phrases longer by one word decide.
    """
    words, inner = F.split("phrase", " "), F.col("size") - 1
    both = F.array(F.slice(words, F.lit(1), inner), F.slice(words, F.lit(2), inner))
    parts = scored.filter("size > 2").select(
        "lang", F.explode(F.transform(both, lambda w: F.array_join(w, " "))).alias("phrase"), F.col("a").alias("longer")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(parts, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")


def mine(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, modulus: int = MODULUS) -> DataFrame:
    """Each language's ``top`` phrases of two to ``longest`` (at least 3) words found ``least`` times.

    Gives ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of the parts of
    its lowest-scoring cut), ``n`` (words of the language) and ``score``.
    """
    chunks = written(dictionary(docs, longest, modulus), "chunks")
    totals = written(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("many")).alias("n")), "totals")
    marks: list[Broadcast] = []
    often: DataFrame | None = None
    sizes = [range(size, size + 1) for size in range(1, min(longest, MARKED) + 1)]
    for own in [*sizes, *([range(MARKED + 1, longest + 1)] if longest > MARKED else [])]:
        found = _often(_runs_of(chunks, own, marks), least)
        often = found if often is None else often.unionByName(found)
        if own[0] <= MARKED:
            marks.append(_marks(found))
    named = _runs_of(chunks, range(1, longest + 1), marks, _marks(often, owners=True))
    texts_ = named.groupBy("key").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    frequent = written(often.join(texts_, "key").select("lang", "phrase", "size", "n"), "phrases")
    scored = written(_scored(frequent, totals), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: the best of each salt first.
    salted = _maximal(scored).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    best = some.filter(F.col("_place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return best.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

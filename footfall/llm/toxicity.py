"""Toxicity by compression distance.

One zstandard dictionary is trained on windows of ordinary text and two on windows of
toxic text: the windows of toxic documents around phrases of one to three words that come
back there in many contexts and not in ordinary ones, and the single words among those. A
text is compared at both scales, in overlapping windows of ``WINDOW`` words, of which any
phrase of three words lies whole in one, and word by word. A window is compressed against
the ordinary dictionary with and without the toxic one in front; where that saves bytes,
the window speaks as toxic text does. Only windows that have more bytes in a row in common
with the toxic dictionary than with the ordinary one are compressed: on the others both
find the same matches. From how many bytes on a window of several words
counts is calibrated on ordinary windows. How many windows count, how much they save and
how dense they are is turned into a probability by a logistic calibration on the labelled
documents; what the dictionaries save on these is worked out by tasks, as scores are.

Null and empty texts have no windows and get the calibrated score of none. Repeated rows
are scored each, an empty table gives an empty result, and a column that has the name of
the score, in any case of letters, is replaced. A text of any length is scored whole, its
words in the memory of one task. Without a toxic or an ordinary document to learn from,
or one phrase that comes back, all scores are the share of toxic labels (0 without labels);
a scale without such a phrase decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import per_batch, written

#: At most so many labelled documents, of at most so many characters, are learned from.
TRAIN_ROWS = 9000
TRAIN_CHARS = 20_000
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2048
ORDINARY_WORDS, ORDINARY_WINDOWS = 12, 30_000
#: A toxic phrase has a distinct left neighbour for so many toxic documents (copies of a
#: document bring none), within bounds, and is TIMES as frequent there as in ordinary ones.
PHRASE = 3
DOCS_PER_CONTEXT, LEAST_CONTEXTS, MOST_CONTEXTS, TIMES = 100, 4, 8, 10.0
LEVEL = 9
#: Both dictionaries end with this text and so does each window: matches are not looked
#: for in the last bytes of a frame, and the cost of the frame cancels out.
CARRIER = b"<a text that both dictionaries end with; 0123456789 abcdefghij ABCDEFGHIJ>"
#: Words of a window and from one window to the next; PHRASE words lie whole in one.
WINDOW = 6
STEP = WINDOW - PHRASE + 1
#: Bytes that a word must save to count, and the part of ordinary windows of several words
#: that may save as much as one that counts.
SAVED, ORDINARY_PART, CHECKED_WINDOWS = 2, 0.005, 30_000
#: Bytes in a row that are compared before a window is compressed: the shortest match, and
#: those of one 64-bit number.
SHORTEST, LONGEST = 4, 8
LIKELY_BITS = 18
#: Windows or words looked at together, ordinary documents learned from together, and tasks
#: that measure the documents learned from.
BLOCK, BLOCK_DOCS, TRAIN_TASKS = 8192, 256, 24
KEPT_WORDS = 700_000
KEPT_LENGTH = 48
MARKS = ".,!?;:\"'()#$%&*|<>[]"
THRESHOLD = 0.3


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def stripped(text: str | None) -> list[str]:
    """The words without the marks around them, empty where nothing is left."""
    return [word.strip(MARKS) for word in words(text)]


@dataclass(frozen=True)
class Model:
    """The dictionaries, the bytes a window must save to count, and the calibration."""

    ordinary: bytes
    toxic: bytes
    phrases: bytes
    least: int
    weights: tuple[float, ...]


class Closer:
    """Where a text has more bytes in a row in common with one content than with another.

    Runs longer than ``LONGEST`` count without a look at the other content.
    """

    def __init__(self, content: bytes, other: bytes):
        whole = content + other[: LONGEST - 1]
        self._grams = []
        self._likely = np.zeros(1 << LIKELY_BITS, dtype=bool)
        for k in range(SHORTEST, LONGEST + 1):
            own = {whole[i : i + k] for i in range(len(whole) - k + 1)}
            if k == SHORTEST:
                self._likely[self._slot(np.array([int.from_bytes(x, "little") for x in own], dtype=np.uint32))] = True
            if k < LONGEST:
                own -= {other[i : i + k] for i in range(len(other) - k + 1)}
            self._grams.append((k, np.array(sorted(int.from_bytes(x, "little") for x in own), dtype=np.uint64)))

    @staticmethod
    def _slot(four: np.ndarray) -> np.ndarray:
        return four * np.uint32(0x9E3779B1) >> np.uint32(32 - LIKELY_BITS)

    def runs(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where such runs begin, in order, and where the shortest of each place ends."""
        padded = text + bytes(LONGEST)
        place = np.flatnonzero(self._likely[self._slot(np.ndarray(len(text), "<u4", padded, 0, (1,)))])
        eight = np.ndarray(len(text), "<u8", padded, 0, (1,))[place]
        length = np.zeros(len(place), dtype=np.int64)
        for k, grams in reversed(self._grams):
            if len(grams):
                own = eight & np.uint64((1 << 8 * k) - 1)
                length[grams[np.minimum(np.searchsorted(grams, own), len(grams) - 1)] == own] = k
        return place[length > 0], (place + length)[length > 0]


class Savings:
    """Bytes that a dictionary in front of the ordinary one saves on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self._plain, one = self._compressor(ordinary)
        self._toxic, two = self._compressor(toxic + ordinary)
        self._base = len(self._plain(CARRIER)) - len(self._toxic(CARRIER))
        # With the same parameters, up to this strategy, the longest match is taken and of
        # several the nearest, which the ordinary dictionary has. No run may reach the carrier.
        same = one == two and one[0] <= zstandard.STRATEGY_LAZY2 and b" " + CARRIER[:1] not in toxic + ordinary[:1]
        self._closer = Closer(toxic, ordinary + CARRIER) if same else None

    @staticmethod
    def _compressor(content: bytes):
        data = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=256, dict_size=len(content) + len(CARRIER), min_match=SHORTEST,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        data.precompute_compress(compression_params=options)
        own = (options.strategy, options.window_log, options.hash_log, options.chain_log, options.search_log, options.target_length)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=options).compress, own

    def of(self, window: bytes) -> int:
        window += CARRIER
        return max(0, len(self._plain(window)) - len(self._toxic(window)) - self._base)

    def over(self, text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``of`` each window of ``text``; both its bounds grow from window to window."""
        out = np.full(len(start), max(0, -self._base), dtype=np.int32)
        if self._closer:
            begins, ends = self._closer.runs(text)
            first, last = np.searchsorted(end, ends), np.searchsorted(start, begins, "right")
            inside = first < last
            within = np.bincount(first[inside], minlength=len(out) + 1) - np.bincount(last[inside], minlength=len(out) + 1)
            look = np.flatnonzero(np.cumsum(within[: len(out)]))
        else:
            look = np.arange(len(out))
        for i, low, high in zip(look.tolist(), start[look].tolist(), end[look].tolist(), strict=True):
            out[i] = self.of(text[low:high])
        return out


def _joined(own: list[str]) -> tuple[bytes, np.ndarray]:
    """The words with a space before, between and after them, and where the spaces are."""
    text = f" {' '.join(own)} ".encode()
    return text, np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)


def _spans(bare: list[str]) -> Iterable[tuple[bytes, np.ndarray, np.ndarray]]:
    """The overlapping windows of a text's words: pieces of it, with the bounds of their windows."""
    many = max(1, len(bare) - WINDOW + STEP) if bare else 0
    for low in range(0, many, STEP * BLOCK):
        own = bare[low : low + STEP * (BLOCK - 1) + WINDOW]
        text, space = _joined(own)
        first = np.arange(0, min(many - low, STEP * BLOCK), STEP)
        yield text, space[first], space[np.minimum(first + WINDOW, len(own))] + 1


def windows(bare: list[str]) -> Iterable[bytes]:
    """The overlapping windows of a text's words (without marks around them)."""
    for text, start, end in _spans(bare):
        yield from (text[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True))


def _summary(value: np.ndarray, least: int, own: int) -> tuple[float, ...]:
    """Windows that count, the most that one saves, bytes saved per 100 words."""
    value = value[value >= least]
    if not len(value):
        return 0.0, 0.0, 0.0
    return float(np.log1p(len(value))), float(value.max()), float(np.log1p(100.0 * value.sum() / own))


class Saved:
    """What the toxic dictionaries save on texts; a task's distinct words are compressed once."""

    def __init__(self, model: Model):
        self._word = Savings(model.ordinary, model.toxic) if model.toxic else None
        self._phrase = Savings(model.ordinary, model.phrases) if model.phrases else None
        self._least = model.least
        self.known: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        for low in range(0, len(new), BLOCK):
            block = new[low : low + BLOCK]
            bare = [word.strip(MARKS) for word in block]
            self.known.update(dict.fromkeys(block, 0))
            text, space = _joined([w for w in bare if w])
            if len(text) > 2:
                saved = self._word.over(text, space[:-1], space[1:] + 1)
                self.known.update(zip((w for w, own in zip(block, bare, strict=True) if own), saved.tolist(), strict=True))

    def values(self, own: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in set(own) if w not in known]
        if len(known) + len(new) > KEPT_WORDS:
            known = self.known = {}
            new = list(set(own))
        self._learn(new)
        out = np.fromiter(map(known.__getitem__, own), dtype=np.int16, count=len(own))
        for word in new:
            if len(word) > KEPT_LENGTH:
                del known[word]
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text the summary of its words and that of its windows of several words."""
        out = np.zeros((len(texts), 6))
        for i, text in enumerate(texts):
            own = words(text)
            if self._word:
                out[i, :3] = _summary(self.values(own), SAVED, len(own))
            if self._phrase:
                bare = [w for w in (word.strip(MARKS) for word in own) if w]
                several = [np.zeros(0, dtype=np.int32), *(self._phrase.over(*span) for span in _spans(bare))]
                out[i, 3:] = _summary(np.concatenate(several), self._least, len(own))
        return out


class Places:
    """The words of documents as one array of codes, and what begins at each place."""

    def __init__(self, documents: list[list[str]], codes: dict[str, int]):
        lengths = [len(own) for own in documents]
        self.size = max(1, sum(lengths))
        self.words = np.fromiter(
            (codes.setdefault(w, len(codes)) for own in documents for w in own), dtype=np.int64, count=sum(lengths)
        )
        self.document = np.repeat(np.arange(len(documents)), lengths)
        first = np.ones(len(self.words), dtype=bool)
        first[1:] = self.document[1:] != self.document[:-1]
        self.before = np.where(first, 0, np.roll(self.words, 1))

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase of ``n`` words begins, and a 64-bit number of each phrase."""
        count = max(0, len(self.words) - n + 1)
        whole = self.document[:count] == self.document[n - 1 : n - 1 + count]
        key = np.zeros(count, dtype=np.uint64)
        for j in range(n):
            own = self.words[j : j + count]
            whole &= own != 0
            key = (key ^ own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        place = np.flatnonzero(whole)
        return place, key[place]

    def pairs(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a phrase and its left neighbour, by number, and their phrases."""
        pair = (key ^ self.before[place].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
        pair, one = np.unique(pair, return_index=True)
        return pair, key[one]

    def contexts(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct phrases, in order, and how many distinct left neighbours each has."""
        return np.unique(self.pairs(place, key)[1], return_counts=True)


class Recurring:
    """Phrases of ``n`` words that come back in toxic documents, less those that ordinary ones have as well.

    Ordinary documents are shown one part after the other; a phrase that has too many
    contexts there is forgotten at once, with its contexts.
    """

    def __init__(self, bad: Places, n: int, least: int):
        self._n = n
        self._place, self._key = bad.phrases(n)
        phrase, seen = bad.contexts(self._place, self._key)
        self._phrase, self._seen = phrase[seen >= least], seen[seen >= least]
        self._part = self._seen / bad.size
        self._elsewhere = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))

    def leave_out(self, good: Places, size: int) -> None:
        """Leaves out what is too frequent in ``good`` and the parts before it, of ``size`` words in all."""
        place, key = good.phrases(self._n)
        common = self._among(key)
        pair, key = (np.concatenate(x) for x in zip(self._elsewhere, good.pairs(place[common], key[common]), strict=True))
        pair, one = np.unique(pair, return_index=True)
        key = key[one]
        known, often = np.unique(key, return_counts=True)
        elsewhere = np.full(len(self._phrase), 0.5)
        elsewhere[np.isin(self._phrase, known)] += often
        own = self._part >= TIMES * elsewhere / size
        self._phrase, self._seen, self._part = self._phrase[own], self._seen[own], self._part[own]
        kept = self._among(key)
        self._elsewhere = pair[kept], key[kept]

    def _among(self, key: np.ndarray) -> np.ndarray:
        """Which of these are phrases that are left."""
        if not len(self._phrase):
            return np.zeros(len(key), dtype=bool)
        return self._phrase[np.minimum(np.searchsorted(self._phrase, key), len(self._phrase) - 1)] == key

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the phrases left, and their numbers of contexts."""
        at = self._among(self._key)
        return self._place[at], self._seen[np.searchsorted(self._phrase, self._key[at])]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _samples(bad: list[list[str]], good: list[str | None], size: int) -> tuple[list[bytes], list[bytes]]:
    """Toxic words, each as often as it has contexts, and the windows around toxic phrases.

    ``size`` is how many words the ordinary texts have.
    """
    codes = {"": 0}
    toxic = Places(bad, codes)
    least = min(MOST_CONTEXTS, max(LEAST_CONTEXTS, len(bad) // DOCS_PER_CONTEXT))
    recurring = [Recurring(toxic, n, least) for n in range(1, PHRASE + 1)]
    for low in range(0, max(1, len(good)), BLOCK_DOCS):
        ordinary = Places([stripped(t) for t in good[low : low + BLOCK_DOCS]], codes)
        for phrases in recurring:
            phrases.leave_out(ordinary, max(1, size))
    start = np.cumsum([0, *(len(own) for own in bad)])
    single: dict[str, int] = {}
    around: list[bytes] = []
    for n, phrases in enumerate(recurring, 1):
        for place, contexts in zip(*(x.tolist() for x in phrases.places()), strict=True):
            document = int(toxic.document[place])
            own, i = bad[document], place - int(start[document])
            if n == 1:
                single[own[i]] = min(contexts, 200)
            around.append(f" {' '.join(own[max(0, i - 1) : i + n + 1])} ".encode())
    return [f" {word} ".encode() for word, many in single.items() for _ in range(many)], around


def _dictionary(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """A trained dictionary, empty where there is too little text for one."""
    order = np.random.default_rng(7).permutation(len(samples))
    try:
        return zstandard.train_dictionary(size, [samples[i] for i in order], k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b""


def learn(texts: list[str | None], toxic: list[int]) -> Model:
    """A model of labelled texts before its calibration: every score is the share of toxic labels.

    Ordinary texts, most of them, are cut into words one after the other, each time anew.
    """
    share = (sum(toxic) + 1e-3) / (len(toxic) + 1.0)
    flat = Model(b"", b"", b"", SAVED, (float(np.log(share / (1 - share))), *[0.0] * 6))
    one: dict[str, str] = {}  # each distinct word is held once
    bad = [[one.setdefault(w, w) for w in stripped(t)] for t, k in zip(texts, toxic, strict=True) if k == 1]
    good = [t for t, k in zip(texts, toxic, strict=True) if k == 0]
    lengths = [len(words(t)) for t in good]
    many = sum(-(-n // ORDINARY_WORDS) for n in lengths)
    places = ((own, i) for own in map(stripped, good) for i in range(0, len(own), ORDINARY_WORDS))
    long = [
        (" " + " ".join(own[i : i + ORDINARY_WORDS]) + " ").encode()
        for own, i in islice(places, 0, None, max(1, many // ORDINARY_WINDOWS))
    ]
    single, around = _samples(bad, good, sum(lengths))
    try:
        ordinary = zstandard.train_dictionary(ORDINARY_BYTES, long, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text for a dictionary
        return flat
    toxic_part, phrases = (_dictionary(TOXIC_BYTES, samples, 32, 6) for samples in (single, around))
    if not toxic_part and not phrases:
        return flat
    least = SAVED
    if phrases:
        saves = Savings(ordinary, phrases).of
        apart = max(1, sum(lengths) // STEP // CHECKED_WINDOWS)
        every = (w for own in map(stripped, good) for w in windows([x for x in own if x]))
        seen = [saves(w) for w in islice(every, 0, None, apart)]
        least = max(SAVED, int(np.quantile(seen, 1 - ORDINARY_PART)) + 1) if seen else SAVED
    return Model(ordinary, toxic_part, phrases, least, flat.weights)


def calibrated(model: Model, x: np.ndarray, toxic: list[int]) -> Model:
    """The model with weights for the features ``x`` of labelled texts."""
    return replace(model, weights=tuple(_logistic(x, np.array(toxic, dtype=float)).tolist()))


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """A model of labelled texts."""
    model = learn(texts, toxic)
    return calibrated(model, Saved(model).features(texts), toxic) if model.ordinary else model


def train(docs: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Learns from at most ``TRAIN_ROWS`` labelled documents, drawn by hash.

    ``usable`` is a condition on ``doc_id`` that labelled rows must meet.
    """
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("_toxic")).filter(F.col("_toxic").isin(0, 1))
    if usable is not None:
        own = own.filter(usable)
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id", "_toxic").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS)
    rows = written(texts.join(F.broadcast(drawn), "doc_id").repartition(TRAIN_TASKS), "toxicity-rows")
    # In order, so that sums of the same rows are the same.
    found = rows.orderBy("doc_id", "text", "_toxic").select("text", "_toxic").toArrow()
    model = learn(*(found.column(c).to_pylist() for c in ("text", "_toxic")))
    del found
    if not model.ordinary:
        return model
    measured = written(_measured(rows, model, "_x"), "toxicity-measured")
    measured = measured.orderBy("doc_id", "text", "_toxic").select("_x", "_toxic").toArrow()
    return calibrated(model, np.array(measured.column("_x").to_pylist()), measured.column("_toxic").to_pylist())


def _measured(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of ``docs`` and the features of its texts."""

    def make():
        saved = Saved(model)

        def work(batch: pa.RecordBatch):
            x = pa.array(saved.features(batch.column("text").to_pylist()).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], [*batch.schema.names, name])

        return work

    return docs.mapInArrow(per_batch(make), T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that a text is toxic, as ``name``.

    Columns of that name are replaced, in any case of letters.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower()])

    def make():
        saved = Saved(model) if model.ordinary else None
        weights = np.array(model.weights)

        def work(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            x = saved.features(texts) if saved else np.zeros((len(texts), 6))
            p = probability(weights[0] + x @ weights[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

        return work

    return docs.mapInArrow(per_batch(make), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))

"""Language of every word and document: a linear-chain conditional random field.

Each word has the affixes, character trigrams and lexicon entry of its letters as hashed
features; learned transitions tie neighbouring words, and forward-backward gives each word
its distribution over the languages. A document's language comes from the share of each
language in all of it, in its first words and in its last words, by weights learned from
the labelled documents: a text may switch to another language in between.

Null texts and texts without a letter are ``und`` with score 0. Very long texts are
processed whole, in blocks tied by exact block transfer matrices. Repeated rows are
labelled each; an empty table gives an empty result. Without labelled documents all texts
are ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import per_batch
from .words import Texts, mix, per_text, texts

#: At most so many labelled documents, of at most so many characters, are learned from.
TRAIN_ROWS = 2400
TRAIN_CHARS = 8000
TABLE_BITS = 16
AFFIXES = (1, 2, 3)
EPOCHS = 4
ENDS = 24
BLOCK = 64
UNKNOWN = "und"
CHUNK_BYTES = 1 << 19


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # hashed feature -> language, log weights
    start: np.ndarray
    moves: np.ndarray  # from language -> to language, log weights
    decision: np.ndarray  # shares -> language


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    salted = mix(hashes + np.uint64((kind + 1) * 0xA0761D6478BD642F % (1 << 64)))
    return (salted >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(t: Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of each word's affixes and lexicon entry; trigram slots with their words."""
    starts, ends = t.starts, t.ends
    own = [_slots(t.spans(starts, ends, lower=True), 0)]
    for i, size in enumerate(AFFIXES):
        own.append(_slots(t.spans(starts, np.minimum(starts + size + 1, ends), lower=True), 1 + 2 * i))
        own.append(_slots(t.spans(np.maximum(ends - size - 1, starts), ends, lower=True), 2 + 2 * i))
    length = np.maximum(ends - starts - 2, 0)
    words = np.repeat(np.arange(len(starts)), length)
    begins = np.cumsum(length) - length
    at = np.arange(len(words)) - np.repeat(begins, length) + starts[words] if len(words) else words
    return own, _slots(t.spans(at, at + 3, lower=True), 9), words


def emissions(t: Texts, table: np.ndarray) -> np.ndarray:
    """Log weight of each language for each word."""
    own, trigrams, words = features(t)
    out = np.zeros((len(t.starts), table.shape[1]))
    for slots in own:
        out += table[slots]
    sums = np.zeros((len(trigrams) + 1, table.shape[1]))
    np.cumsum(table[trigrams], axis=0, out=sums[1:])
    edges = np.searchsorted(words, np.arange(len(t.starts) + 1))
    return out + sums[edges[1:]] - sums[edges[:-1]]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def marginals(weights: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Each word's distribution, by forward-backward over each text's words.

    Texts are cut into blocks. Blocks are multiplied out side by side, then their
    products along each text, then the words within each block, in both directions.
    """
    n, k = weights.shape
    if not n:
        return weights
    e = np.exp(weights - weights.max(axis=1, keepdims=True)) + 1e-12
    a = np.exp(moves - moves.max())
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    many = int(first_block[-1])
    text = np.repeat(np.arange(len(counts)), blocks)
    begin = first[:-1][text] + (np.arange(many) - first_block[:-1][text]) * BLOCK
    size = np.minimum(BLOCK, first[1:][text] - begin)
    order = np.argsort(-size, kind="stable")
    active = [order[: int(np.searchsorted(-size[order], -j, side="left"))] for j in range(BLOCK)]

    product = np.broadcast_to(np.eye(k), (many, k, k)).copy()
    for j in range(BLOCK):
        rows = active[j]
        if not len(rows):
            break
        step = (product[rows] @ a) * e[begin[rows] + j][:, None, :]
        product[rows] = _scaled(step)
    # The first word of a text has the start weights instead of a move into it.
    into = np.zeros((many, k))
    out_of = np.ones((many, k)) / k
    lead = np.exp(start - start.max())
    longest = int(blocks.max())
    lasting = np.argsort(-blocks, kind="stable")
    prior = np.linalg.solve(a.T + 1e-9 * np.eye(k), lead)  # prior @ a is the start
    state = np.broadcast_to(prior, (len(counts), k)).copy()
    for j in range(longest):
        rows = lasting[: int(np.searchsorted(-blocks[lasting], -j, side="left"))]
        at = first_block[rows] + j
        into[at] = state[rows]
        after = np.einsum("nk,nkl->nl", state[rows], product[at])
        state[rows] = after / after.sum(axis=1, keepdims=True)
    state = np.ones((len(counts), k)) / k
    for j in range(longest - 1, -1, -1):
        rows = lasting[: int(np.searchsorted(-blocks[lasting], -j, side="left"))]
        at = first_block[rows] + j
        out_of[at] = state[rows]
        before = np.einsum("nkl,nl->nk", product[at], state[rows])
        state[rows] = before / before.sum(axis=1, keepdims=True)

    forward = np.empty((n, k))
    carry = into
    for j in range(BLOCK):
        rows = active[j]
        if not len(rows):
            break
        step = (carry[rows] @ a) * e[begin[rows] + j]
        carry[rows] = forward[begin[rows] + j] = step / step.sum(axis=1, keepdims=True)
    backward = np.empty((n, k))
    carry = out_of
    for j in range(BLOCK - 1, -1, -1):
        rows = active[j]
        if not len(rows):
            continue
        at = begin[rows] + j
        backward[at] = carry[rows]
        step = (carry[rows] * e[at]) @ a.T
        carry[rows] = step / step.sum(axis=1, keepdims=True)
    both = np.maximum(forward, 0) * np.maximum(backward, 0) + 1e-300
    return both / both.sum(axis=1, keepdims=True)


def shares(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the mean distribution of all, the first and the last words; 0 without words."""
    sums = np.zeros((len(word) + 1, word.shape[1]))
    np.cumsum(word, axis=0, out=sums[1:])
    low, high = first[:-1], first[1:]
    parts = [(low, high), (low, np.minimum(low + ENDS, high)), (np.maximum(high - ENDS, low), high)]
    return np.hstack([(sums[b] - sums[a]) / np.maximum(b - a, 1)[:, None] for a, b in parts])


def _letters(t: Texts) -> np.ndarray:
    """Texts that hold an ASCII letter or one of the common letters beyond it."""
    alpha = np.zeros(256, dtype=bool)
    alpha[65:91] = alpha[97:123] = True
    return per_text(alpha[t.data], t.offsets) > 0


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(own: list[str], labels: list[str]) -> Model | None:
    """A model of labelled texts.

    Words start with their document's language; from then on each epoch takes the words'
    own marginals under the current model, within the document's plausible languages, and
    moves emissions by the field's gradient (expected features under the labels less those
    under the model). Transitions are not learned by the gradient: they are set to smoothed
    counts of products of neighbouring words' marginals; the start weights stay zero.
    """
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    k = len(languages)
    code = np.array([languages.index(x) for x in labels])
    table = np.zeros((1 << TABLE_BITS, k))
    start, moves = np.zeros(k), np.eye(k) * 2.0
    chunks = [(low, high, t) for low, high, t in texts(pa.array(own, pa.string()), CHUNK_BYTES)]
    slots = [features(t) for _, _, t in chunks]

    def gathered(targets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros_like(table)
        for (_, _, t), (affixes, trigrams, words), target in zip(chunks, slots, targets, strict=True):
            for s in affixes:
                for j in range(k):
                    out[:, j] += np.bincount(s, target[:, j], minlength=len(out))
            for j in range(k):
                out[:, j] += np.bincount(trigrams, target[words, j], minlength=len(out))
        return out

    # Start: smoothed log ratios of each feature among the documents of a language.
    hard = [np.eye(k)[np.repeat(code[low:high], t.counts)] for low, high, t in chunks]
    counts = gathered(hard)
    rate = (counts + 0.2) / (counts.sum(axis=0, keepdims=True) + 1.0)
    table = (np.log(rate) - np.log(rate.mean(axis=1, keepdims=True))) / 3.0
    for _ in range(EPOCHS):
        target, model = [], []
        for (low, high, t), before in zip(chunks, hard, strict=True):
            p = marginals(emissions(t, table), t.first, start, moves)
            model.append(p)
            # A labelled document is mostly of its language: words elsewhere need evidence.
            q = p * np.where(before > 0, 1.0, 0.05)
            target.append(q / q.sum(axis=1, keepdims=True))
        wanted, got = gathered(target), gathered(model)
        table += 0.5 * (wanted - got) / (np.sqrt(counts.sum(axis=1, keepdims=True)) + 5.0)
        pair = np.full((k, k), 0.5)
        for (_, _, t), q in zip(chunks, target, strict=True):
            inner = np.ones(len(q), dtype=bool)
            inner[t.first[:-1][t.counts > 0]] = False
            at = np.flatnonzero(inner)
            pair += q[at - 1].T @ q[at]
        moves = np.log(pair / pair.sum(axis=1, keepdims=True))

    x = np.vstack([
        shares(marginals(emissions(t, table), t.first, start, moves), t.first) for _, _, t in chunks
    ])
    decision = np.vstack([np.eye(k) * 4.0, np.eye(k), np.eye(k)])
    y = np.eye(k)[code]
    for _ in range(400):
        decision -= 2.0 * (x.T @ (_softmax(x @ decision) - y) / len(x) + 1e-4 * decision)
    return Model(languages, table.astype(np.float32), start, moves, decision)


def train(docs: DataFrame, usable=None) -> Model | None:
    """Learns from at most ``TRAIN_ROWS`` documents with a language, drawn by hash.

    ``usable`` is a condition on ``doc_id`` that they must meet.
    """
    own = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    own = own.filter(F.length("text") <= TRAIN_CHARS)
    if usable is not None:
        own = own.filter(usable)
    drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(TRAIN_ROWS).toArrow()
    rows = sorted(zip(*[drawn.column(n).to_pylist() for n in ("text", "lang")], strict=True))
    return fit([r[0] for r in rows], [r[1] for r in rows])


def predict(t: Texts, model: Model) -> np.ndarray:
    """Each text's distribution over the languages."""
    word = marginals(emissions(t, model.table), t.first, model.start, model.moves)
    return _softmax(shares(word, t.first) @ model.decision)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every whole text."""
    own = docs.select("doc_id", "text")

    def make():
        def work(batch: pa.RecordBatch):
            column = batch.column("text")
            names: list[str] = []
            scores: list[np.ndarray] = []
            for low, high, t in texts(column, CHUNK_BYTES) if model else []:
                p = predict(t, model)
                known = _letters(t)
                for i in np.flatnonzero(~known):
                    known[i] = _has_letter(column[low + int(i)].as_py())
                best = p.argmax(axis=1)
                names += [model.languages[j] if ok else UNKNOWN for j, ok in zip(best, known, strict=True)]
                scores.append(np.where(known, p.max(axis=1), 0.0))
            if not model:
                names, scores = [UNKNOWN] * len(column), [np.zeros(len(column))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                ["doc_id", "lang_pred", "score"],
            )

        return work

    schema = T.StructType([
        own.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])
    return own.mapInArrow(per_batch(make), schema)

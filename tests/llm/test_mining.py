"""Phrases, hard negatives and exact search against brute force, and odd inputs."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.llm import negatives, phrases, pivots, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = [None, "", " \n\t", "a", "A. a, a; a", "é☃ ﬁ\x85x b", "x" * 5000, "w " * 3000, "a\na\n\nb\na", "a b" + "," * 40 + "a b"]


def words_of(text):
    folded = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", folded)]


def phrase_table(rows, least, top, longest=5):
    found, total = Counter(), Counter()
    for text, lang in rows:
        for own in words_of(text):
            total[lang or "und"] += len(own)
            found.update((lang or "und", tuple(own[i : i + n])) for n in range(1, longest + 1) for i in range(len(own) - n + 1))
    chosen = {k: c for k, c in found.items() if len(k[1]) > 1 and c >= least}
    inside = {
        (lang, p[i:j]) for (lang, p), c in chosen.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
        if j - i < len(p) and found[lang, p[i:j]] <= c
    }
    ranked = defaultdict(list)
    for (lang, p), a in chosen.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * total[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
            ranked[lang].append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -score)
        for lang, own in ranked.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:top])
    }


def corpus(seed, count):
    r = random.Random(seed)
    passage = " ".join(r.choice("abcdefghij") * 2 for _ in range(80))
    out = []
    for i in range(count):
        own = "".join(r.choice("abcdefgh") + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(90)))
        out.append((own + (passage if i % 3 == 0 else ""), r.choice(["en", "de", None])))
    return [*out, *out[:5], *[(t, "en") for t in ODD]]


@pytest.mark.parametrize(("modulus", "longest", "top"), [(2, 5, 2000), (32, 5, 7), (1, 3, 2000), (10**9, 4, 50)])
def test_phrases_by_brute_force(spark, modulus, longest, top):
    rows = corpus(modulus % 7, 60)
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int")
    found = [tuple(r) for r in phrases.mine(docs.repartition(3), 6, top, longest, modulus).collect()]
    assert len(found) == len(set(found)) and set(found) == phrase_table(rows, 6, top, longest)


def test_languages_named_like_words(spark):
    rows = [("de es. de es de", "es")] * 4 + [("es de. es x", "de")] * 3 + [("es", "es"), ("und de", None), ("de und", "und")] * 3
    found = [tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "text string, lang string"), 3).collect()]
    assert len(found) == len(set(found)) and set(found) == phrase_table(rows, 3, 2000)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("limit", [4, 50, 1 << 20])
def test_chunks_own_every_word_once(limit):
    texts = [t for t, _ in corpus(5, 30)]
    chunks = defaultdict(list)
    for row, own, chunk in phrases.chunked(pa.array(texts), 4, 4, limit):
        chunks[row].append((own, chunk.decode()))
    for i, text in enumerate(texts):
        every = [(w, j == len(own) - 1) for own in words_of(text) for j, w in enumerate(own)]
        held = [m.groups() for own, c in chunks[i] for m in list(re.finditer(r"([^ \n]+)([ \n]?)", c))[:own]]
        assert [w for w, _ in held] == [w for w, _ in every]
        # A piece's last word is marked, but for the last word of a segment or text.
        assert all((gap == "\n") == last for (_, gap), (_, last) in zip(held[:-1], every[:-1], strict=True) if gap)


def test_equal_passages_share_chunks():
    r = random.Random(8)
    passage = " ".join(str(r.randrange(500)) for _ in range(400))
    own = [Counter(c for _, _, c in phrases.chunked(pa.array([t]), 4, 8)) for t in (f"a b c {passage}", f"{passage} z", passage)]
    assert all((x & y).total() >= 0.9 * min(x.total(), y.total()) for x in own for y in own)


def test_long_text_is_read_in_segments():
    text = "some words, and more. " * 150_000
    parts = list(phrases.chunked(pa.array(["x", text, None, text]), 4, 32))
    assert Counter(row for row, own, _ in parts for _ in range(own)) == {0: 1, 1: 600_000, 3: 600_000}


def table(seed=1, count=400, size=12, scale=1.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(count, size)) * scale
    x[50:60] = x[40]
    x[60:70] *= 0.01
    return x.astype(np.float32)


ODD_VECTORS = [
    (900, None, 0), (901, [float("nan")] * 12, 0), (902, [None] * 12, 0), (903, [float("inf")] + [0.0] * 11, 0),
    (904, [1.0] * 12, None), (None, [1.0] * 12, 0), (1000, [], 1), (1001, [0.0] * 12, 0), (1002, [3.0, -2.0], 1),
]


def vectors(spark, x, odd=ODD_VECTORS):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + odd
    own = spark.createDataFrame([(*r, 1, 2.0, "q") for r in rows], "vec_id long, embedding array<float>, label int, v int, score double, query_id string")
    return own.repartition(3), rows


def whole(rows, scale, size, labels):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or (labels and label is None) or any(c is None or not np.isfinite(c) for c in v):
            continue
        own[i] = (label, np.array([int(np.floor(scale * float(np.float32(c)))) for c in v] + [0] * (size - len(v)), dtype=object))
    return own


def best(own, query, scale):
    scored = [(-int((own[query][1] * v).sum()), i) for i, (_, v) in own.items() if i != query]
    return [(i, -s) for s, i in sorted(scored)]


@pytest.mark.parametrize(("scale", "block"), [(1.0, 2048), (1.0, 7), (50_000.0, 64)])
def test_search_by_brute_force(spark, monkeypatch, scale, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "SAMPLE", 50)
    df, rows = vectors(spark, table(scale=scale))
    own = whole(rows, 1024, 12, False)
    found = [tuple(r) for r in pivots.search(df.unionByName(df.limit(20)), F.col("vec_id") % 20 == 0).collect()]
    expected = {(q, r + 1, i, s) for q in own if q % 20 == 0 for r, (i, s) in enumerate(best(own, q, 1024)[:10])}
    assert len(found) == len(expected) and set(found) == expected


def test_search_of_few(spark):
    df, rows = vectors(spark, table()[:3], [])
    assert pivots.search(df, F.col("vec_id") == 0).count() == 2
    assert pivots.search(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert pivots.search(df.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    assert pivots.search(df, F.col("vec_id") == 7).count() == 0


def test_scores_beyond_64_bits_are_refused(spark):
    df, _ = vectors(spark, table(scale=1e12), [])
    with pytest.raises(ValueError, match="64 bits"):
        pivots.search(df, F.col("vec_id") == 0).count()


def test_pivots_spare_evaluations():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 200
    x = np.floor(centres[r.integers(40, size=2000)] + r.normal(size=(2000, 16)) * 10)
    found = pivots.Table(pivots.Shape(2000, 16, 1000), pivots.choose_pivots(x[:500], 24), np.arange(500), x[:500])
    square, apart = found.distances(x)
    block = pivots.Block(np.arange(2000), x, square, apart)
    least = np.full(20, pivots.NONE)
    score, ids, evaluated = block.best(np.arange(20), x[:20], square[:20], apart[:20], least, 10)
    exact = (x[:20] @ x.T).astype(np.int64)
    exact[np.arange(20), np.arange(20)] = pivots.NONE
    assert (score == np.sort(exact, axis=1)[:, :-11:-1]).all() and evaluated < 0.5 * 20 * 2000


@pytest.mark.parametrize(("scale", "block", "sample"), [(1.0, 2048, 4096), (1.0, 9, 40), (20_000.0, 64, 1)])
def test_negatives_by_brute_force(spark, monkeypatch, scale, block, sample):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    df, rows = vectors(spark, table(2, scale=scale))
    own = whole(rows, 256, 12, True)
    found = [tuple(r) for r in negatives.mine(df.unionByName(df.limit(20)), F.col("label"), F.col("vec_id") % 20 == 0).collect()]
    expected = set()
    for a in [i for i in own if i % 20 == 0]:
        near = best(own, a, 256)
        for p, ps in [(i, s) for i, s in near if own[i][0] == own[a][0]][:5]:
            window = [(i, s) for i, s in near if own[i][0] != own[a][0] and 30 * ps <= 100 * s <= 90 * ps]
            expected |= {(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(window[:10])}
    assert len(found) == len(expected) > 100 and set(found) == expected


def test_negatives_of_nothing(spark):
    df, _ = vectors(spark, table()[:30], [])
    every = F.col("vec_id") % 10 == 0
    for own in (df.filter("vec_id < 0"), df.filter("label = 0"), df.filter("vec_id = 3")):
        assert negatives.mine(own, F.col("label"), every).count() == 0
    assert negatives.mine(df, F.lit(None).cast("int"), every).count() == 0


def test_index_leaves_out_dimensions_and_drops_pairs():
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(500, 32)) * np.geomspace(300, 5, 32))
    anchors, least = x[:20], np.full(20, 150_000)
    reach = float((least / np.sqrt((anchors**2).sum(axis=1))).min())
    index = negatives.Index(np.arange(500), [0] * 500, x, np.arange(32), reach)
    who, row, score = index.pairs(anchors, least, np.ones((20, 500), dtype=bool))
    exact = (anchors @ x.T).astype(np.int64)
    assert set(zip(who.tolist(), index.ids[row].tolist(), score.tolist(), strict=True)) == {
        (i, j, int(exact[i, j])) for i, j in zip(*np.nonzero(exact >= 150_000), strict=True)
    }
    assert (index.end < 32).any() and index.touched < 0.7 * 20 * 500 * 32


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_phrases", "op12_hard_negatives", "op13_pivot_search"])
def test_queries_agree_with_sql(spark, monkeypatch, name):
    from checks import compare
    from footfall.llm.oracles import oracles

    monkeypatch.setattr(compare, "registered", queries.registered)
    monkeypatch.setattr(compare, "ORACLES", oracles())
    assert compare.difference(spark, compare.connect(SF_DIR), SF_DIR, name) is None

"""Operators 11 to 13 against plain versions, with nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import collocations, hard_negatives, repeats

# ------------------------------------------------------------------ 11


def plain_repeats(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        pieces = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), pieces, bytes(b for b, x in zip(t, gone) if not x)))
    return out


def edited(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé\0\n ") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(0, len(t))
            t = rng.choice([t[:p] + rng.choice(words) + t[p:], t[p:] + t[:p], t[:p] + rng.choice(base)[: rng.randint(0, 200)] + t[p:]])
        out.append(t)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, monkeypatch, hot):
    if hot:  # all groups are large ones
        monkeypatch.setattr(repeats, "HOT", 300)
    texts = [*edited(1, 90), "a" * 700, "ab" * 200, "b" * 59, "c" * 60, "d" * 61, None, "", "abc" * 900, "x" * 64, "x" * 64]
    ids = [*range(len(texts) - 2), None, None]
    df = spark.createDataFrame([(i, t, "kept", 3) for i, t in zip(ids, texts)], "doc_id long, text string, kept string, h int").repartition(5)
    got = repeats.remove_repeats(df, length=60)
    assert got.columns == ["doc_id", "text", "h", "kept", "n_bytes", "n_removed", "n_spans"]
    rows = sorted(((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=lambda r: (-1 if r[0] is None else r[0], repr(r)))
    want = sorted(((i, t, *w) for i, t, w in zip(ids, texts, plain_repeats([(t or "").encode() for t in texts], 60))), key=lambda r: (-1 if r[0] is None else r[0], repr(r)))
    assert rows == want
    assert repeats.remove_repeats(df.limit(0), length=60).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, length=8)


def test_repeats_in_long_texts(spark):
    """Texts longer than what is hashed at once, one of them of one letter."""
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh"), 2_300_000))
    rows = [(1, text), (2, text[1_000_000:1_000_900]), (3, "z" * 2_200_000), (4, "q" + text[2_299_500:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=400).collect()}
    assert got == {1: (2_300_000, 1400, 2), 2: (900, 900, 1), 3: (2_200_000, 2_200_000, 1), 4: (501, 500, 1)}


@pytest.mark.parametrize("seed", range(4))
def test_maximal_repeats_of_a_suffix_array(seed):
    """All strings that occur twice and can't be made longer at either end, with all their places."""
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(6)]
    sa = repeats.SuffixArray(strings, [len(s) for s in strings])
    got = {}
    for size, lo, hi in sa.maximal_repeats(3):
        places = sorted(int(p) for p in sa.order[lo : hi + 1])
        text = bytes(sa.data[places[0] : places[0] + size])
        assert text not in got
        got[text] = places
    places = collections.defaultdict(list)
    for s, begin in zip(strings, sa.begins.tolist()):
        for i, j in itertools.combinations(range(len(s) + 1), 2):
            if j - i >= 3:
                places[s[i:j]].append(begin + i)
    own = {}
    for text, at in places.items():
        before = {bytes(sa.data[p - 1 : p]) if p not in sa.begins else p for p in at}
        after = {bytes(sa.data[p + len(text) : p + len(text) + 1]) if p + len(text) not in sa.ends else p for p in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1 or len(at) > 1 and any(p in sa.begins for p in at) and len(after) > 1:
            own[text] = sorted(at)
    assert got == own


# ------------------------------------------------------------------ 12


def plain_collocations(rows, longest=3, threshold=10, share=50, top=2000):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            lower = lower.replace(c, "\n")
        for piece in lower.split("\n"):
            own = [w for w in piece.replace("\t", " ").split(" ") if w]
            words["und" if lang is None else lang] += len(own)
            for n in range(1, longest + 1):
                for i in range(len(own) - n + 1):
                    counts["und" if lang is None else lang][tuple(own[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in found.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = max((b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * longer < share * a:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(7)
    vocabulary = ["the", "The", "cat", "sat", "on", "mat", "été", "ÉTÉ", "日本", "a-b", "x\0y", " ", "z"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! ", "\r\n", ";", " "]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), text(rng.randint(0, 60))) for _ in range(150)]
    return [*rows, ("en", None), (None, ""), ("fr", " \t\n"), ("en", "the cat " * 2000), *[rows[0]] * 30]


@pytest.mark.parametrize(("longest", "top", "share"), [(3, 2000, 50), (4, 7, 30), (2, 5, 50)])
def test_collocations(spark, phrases, longest, top, share):
    df = spark.createDataFrame([(*r, 1) for r in phrases], "lang string, text string, phrase int").repartition(3)
    got = collocations.collocations(df, longest=longest, top=top, share=share)
    assert sorted(map(tuple, got.collect())) == plain_collocations(phrases, longest, 10, share, top)


def test_collocations_in_small_pieces(spark, phrases, monkeypatch):
    """Many flushes, slices that cut texts, groups of ranks, and a filter that lets all pass."""
    monkeypatch.setattr(collocations, "FLUSH", 400)
    monkeypatch.setattr(collocations, "RANK_ROWS", 5)
    slices = collocations.phrase_slices
    monkeypatch.setattr(collocations, "phrase_slices", lambda batch: slices(batch, most=50))
    monkeypatch.setattr(collocations, "PART_MASS", 50)
    monkeypatch.setattr(collocations, "FILTER_BITS", 4)
    df = spark.createDataFrame(phrases, "lang string, text string").repartition(2)
    assert sorted(map(tuple, collocations.collocations(df).collect())) == plain_collocations(phrases)
    assert collocations.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_summaries_keep_what_is_frequent_in_any_order_of_merging(seed):
    rng = np.random.default_rng(seed)
    mass, threshold = 5000, 40
    items = np.minimum(rng.zipf(1.3, mass), 3000).astype(np.uint32)
    capacity = mass // threshold + 1
    parts = [(*(collocations._combined(x, np.ones(len(x), np.int64))), 0) for x in np.array_split(items, 37)]
    while len(parts) > 1:
        i, j = sorted(rng.choice(len(parts), 2, replace=False))
        b, a = parts.pop(j), parts.pop(i)
        parts.append(collocations.merged(a, b, capacity))
        assert len(parts[-1][0]) <= capacity
    keys, counts, taken = parts[0]
    held, true = dict(zip(keys.tolist(), counts.tolist())), collections.Counter(items.tolist())
    assert taken <= mass / (capacity + 1)
    for k, n in true.items():
        assert held.get(k, 0) <= n <= held.get(k, 0) + taken
    assert {k for k, n in true.items() if n >= threshold} <= {k for k, n in held.items() if n + taken >= threshold}


# ------------------------------------------------------------------ 13


def plain_negatives(rows, anchor, positives, negatives, share, scale):
    ok = [(i, tuple(int(np.floor(scale * x)) for x in v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v, y in ok:
        if anchor(i):
            asked[i] = min(asked.get(i, (v, y)), (v, y))
    out = []
    for q, (v, y) in asked.items():
        others = sorted((-sum(a * b for a, b in zip(v, w)), i, z) for i, w, z in ok if i != q and len(w) == len(v))
        for s, p, _ in [o for o in others if o[2] == y][:positives]:
            found = [(t, n) for t, n, z in others if z != y and -s * share <= -t * 100 <= -s * 100][:negatives]
            out += [(q, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many shards, blocks and cells; searches that end early
        for k, v in {"CELL_ROWS": 4, "SHARD_ROWS": 5, "BLOCK_QUERIES": 3, "PROBE_ROWS": 12, "SAMPLE_ROWS": 100}.items():
            monkeypatch.setattr(hard_negatives, k, v)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(x) for x in np.round(centres[i % 6] + 0.3 * rng.normal(size=5), 1)], int(rng.integers(0, 3))) for i in range(160)]  # clusters, and ties
    rows += [(i, rows[40][1], 1) for i in range(200, 240)]  # one vector many times
    rows += [(300, None, 1), (310, [1.0, None, 1.0, 1.0, 1.0], 1), (320, [float("nan")] * 5, 1), (330, [float("inf"), 1.0, 1.0, 1.0, 1.0], 1), (340, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(350, [1.0, 2.0], 0), (351, [1.0, 2.5], 0), (352, [1.0, 1.9], 1), (360, [3.0], 0), (370, [], 0), (10, [2.0, 0.1, 0.3, -0.5, 0.2], 2), (11, rows[11][1], 0), (380, [0.0] * 5, 0), (390, [1.0] * 7, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, rank int").repartition(4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0, 5, 5, 80, 256)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=2, negatives=9, share=30, scale=8)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0, 2, 9, 30, 8)
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_cells_come_in_order_of_their_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=4)
    got = list(hard_negatives.cells_in_order(a, b))
    assert len({(i, j) for _, i, j in got}) == 28
    assert [round(s, 9) for s, _, _ in got] == sorted((round(x + y, 9) for x in a for y in b), reverse=True)


def test_bounds_hold_for_all_members():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-200, 200, (300, 9)).astype(float), rng.integers(-200, 200, (20, 9)).astype(float)
    books = tuple(hard_negatives.codebook(h, 6) for h in (x[:, :4], x[:, 4:]))
    own = [hard_negatives.nearest(h, c) for h, c in zip((x[:, :4], x[:, 4:]), books)]
    radii = tuple(np.array([r[k == c].max(initial=0) for c in range(len(b))]) for (k, r), b in zip(own, books))
    first, second = hard_negatives.half_bounds(q, books, radii)
    assert (q @ x.T <= first[:, own[0][0]] + second[:, own[1][0]]).all()

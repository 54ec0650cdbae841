"""Resampling, MinHash and phrases against brute force, on tables with nulls, ties, repeats, hot groups and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import minhash, phrases, resample

DOCS = "doc_id long, text string, lang string, score string, Key int, phrase string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark, rows, parts=3):
    rows = [(d, t, lang, "x", 1, "y") for d, t, lang in rows]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def prose(n, seed=1, words=60, size=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß中", k=rng.randint(1, 5))) for _ in range(size)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " A", "\x00 "]
    return ["".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, words))) for _ in range(n)]


ODD = [None, "", "   ", "one", "a b c d", "A B c D e", "a\x01b a b", "é É ß", ".,;", "x" * 70_000, "w " * 5000]


def rows_of(seed=1, n=60):
    texts = ODD + prose(n, seed)
    out = [(k, t, ("en", "de", None)[k % 3]) for k, t in enumerate(texts)]
    return [*out, (None, texts[-1], "en"), (None, None, None), out[20], out[20], (-5, texts[15], "de"), (1 << 40, texts[15], "de")]


def brute_resample(docs, target, least_words, percent=10, most=1, buckets=10_000):
    def features(text):
        w = WORD.findall(brute.lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    have, want = (collections.Counter(b for t in part for b in features(t)[1]) for part in ([t for _, t in docs], target))
    s_all, t_all = sum(have.values()) + buckets, sum(want.values()) + buckets
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * s_all / ((have[b] + 1) * t_all))) for b in have}
    out = []
    for d, t in docs:
        n, found = features(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return out, [r[:4] for r in drawn]


@pytest.mark.parametrize(("least", "percent", "most", "pivots"), [(20, 10, 1, 15), (0, 100, 2, 1), (5, 33, 3, 4), (20, 0, 1, 15), (10**6, 10, 1, 15)])
def test_resample(spark, least, percent, most, pivots):
    rows = rows_of()
    target = prose(10, 7) + [None, "", "W w"]
    bench = spark.createDataFrame([(t, "z") for t in target], "text string, doc_id string")
    got = resample.resample(table(spark, rows), bench, percent, least, most, 500, pivots=pivots).collect()
    want, drawn = brute_resample([r[:2] for r in rows], target, least, percent, most, 500)
    assert sorted(map(str, (r[:4] for r in got))) == sorted(str(tuple(r[:4])) for r in want)
    placed = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in placed] == list(range(1, len(drawn) + 1))
    assert [list(r[:4]) for r in placed] == drawn


def test_resample_empty_tables(spark):
    none, bench = table(spark, [], 1), spark.createDataFrame([], "text string")
    assert resample.resample(none, bench).collect() == []
    got = resample.resample(table(spark, rows_of()), bench).collect()
    assert len(got) == len(rows_of()) and any(r["rank"] for r in got)


def test_quickselect_finds_every_place_and_refuses_others(spark):
    rows = spark.createDataFrame([(k // 7, k % 7) for k in range(100)], "a long, b long").repartition(3)
    for k in (1, 2, 50, 99, 100):
        assert resample.quickselect(rows, ["a", "b"], k, 3) == ((k - 1) // 7, (k - 1) % 7)
    with pytest.raises(ValueError):
        resample.quickselect(rows, ["a", "b"], 101)
    same = spark.createDataFrame([(1, 1)] * 50, "a long, b long")
    assert resample.quickselect(same, ["a", "b"], 30) == (1, 1)


def brute_minhash(docs, percent=85, size=5):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t))
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        to = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), to, d == to))
    return out


def near_copies(seed=3):
    """Groups of near copies around the limit, a chain, and a null id that bridges two texts."""
    rng, out, n = random.Random(seed), [], 100
    for group in range(6):
        base = [f"g{group}w{rng.randint(0, 999)}" for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 99)}"
            out.append((n, " ".join(copy)))
            n += 1
    chain = [f"c{k}" for k in range(200)]
    out += [(n + k, " ".join(chain[5 * k : 5 * k + 80])) for k in range(20)]
    bridge = [f"b{k}" for k in range(100)]
    return [*out, (7001, " ".join(bridge[:90])), (None, " ".join(bridge[:96])), (7002, " ".join(bridge[4:])), (None, "only this one here")]


@pytest.mark.parametrize("tile", [512, 4])
def test_minhash(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE_DOCS", tile)
    monkeypatch.setattr(minhash, "TILE", 8 if tile == 4 else 1024)
    rows = [(d, t, lang) for d, t, lang in rows_of()] + [(d, t, None) for d, t in near_copies()]
    got = [tuple(r) for r in minhash.keep_one(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_minhash([r[:2] for r in rows])))


def test_minhash_of_nothing(spark):
    assert minhash.keep_one(table(spark, [], 1)).collect() == []
    assert {tuple(r) for r in minhash.keep_one(table(spark, [(1, None, None), (2, "", None)])).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_estimate_is_corrected_for_chance():
    rng, perms = np.random.default_rng(5), minhash.permutations()
    for want in (0.0, 0.5, 0.85, 1.0):
        seen = []
        for _ in range(20):
            both, a, b = (rng.integers(0, 2**64, k, np.uint64) for k in (int(400 * want), *[int(400 * (1 - want) / 2)] * 2))
            sides = [minhash.packed(minhash.minima(np.append(both, x), perms))[None] for x in (a, b)]
            seen.append(float(minhash.similarity(*sides)[0]))
        assert abs(np.mean(seen) - want) < 0.04


def brute_phrases(rows, longest=3, least=10, percent=50, top=2000):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        bad = {p[i : i + n] for p, a in found.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * a >= percent * counts[p[i : i + n]]}
        best = []
        for p, a in found.items():
            if p not in bad:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (s, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, k + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "shard", "top", "bits"), [(3, 10, 1000, 2000, 27), (4, 3, 100, 2000, 27), (2, 2, 10**6, 50, 27), (3, 2, 300, 7, 11)])
def test_phrases(spark, monkeypatch, longest, least, shard, top, bits):
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << bits)
    rows = rows_of(2, 150)
    got = phrases.collocations(table(spark, rows), longest, least, 50, top, shard_words=shard).collect()
    want = brute_phrases(rows, longest, least, 50, top)
    assert want and sorted(map(tuple, got)) == want


def test_phrases_of_many_languages_and_none(spark):
    assert phrases.collocations(table(spark, [], 1)).collect() == []
    assert phrases.collocations(table(spark, [(1, None, None), (2, "a b", "en")])).collect() == []
    rows = [(k, "ab cd ab cd ef " * 3, f"l{k % 20}") for k in range(60)]
    got = phrases.collocations(table(spark, rows), shard_words=30).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows)


def test_scores_beyond_64_bits(spark, monkeypatch):
    real = phrases.part_counts
    monkeypatch.setattr(phrases, "part_counts", lambda *a: real(*a).withColumn("f", F.col("f") * 10**13))
    monkeypatch.setattr(phrases, "candidates", lambda c, real=phrases.candidates: real(c).withColumn("a", F.col("a") * 10**13))
    rows = [(1, "a b " * 11, "en"), (2, "b " * 5, "en")]
    plain = {r[2]: r for r in brute_phrases(rows)}
    for r in phrases.collocations(table(spark, rows)).collect():
        assert r["score"] == plain[r["phrase"]][7] and r["a"] == plain[r["phrase"]][3] * 10**13


def test_automata():
    rng = random.Random(3)
    words = [bytes([c]) * rng.randint(1, 3) for c in (*range(1, 9), *range(97, 110))]
    for _ in range(50):
        counts = {tuple(rng.choices(words, k=rng.randint(1, 4))): rng.randint(0, 5) for _ in range(rng.randint(0, 80))}
        made = phrases.CountAutomaton.loads(phrases.CountAutomaton.build(sorted(counts.items())).dumps())
        assert list(made.grams()) == sorted(counts.items())
        asked = {tuple(rng.choices(words, k=rng.randint(1, 4))) for _ in range(30)} | set(list(counts)[:10])
        found = dict(made.compose(phrases.CountAutomaton.build((g, 0) for g in sorted(asked))))
        assert found == {g: counts[g] for g in asked if g in counts}
    for n in (1, 2, 3):
        places = sorted(set(words))
        rows = sorted({tuple(rng.randint(1, len(places)) for _ in range(n)) for _ in range(60)})
        made = phrases.CountAutomaton.build_rows(places, np.array(rows).T, np.arange(60)[: len(rows)] % 4)
        plain = [(tuple(places[k - 1] for k in r), i % 4) for i, r in enumerate(rows)]
        assert list(made.grams()) == plain
        assert len(made.final) == len(phrases.CountAutomaton.build(plain).final)
    words = sorted(set(words))
    squares = [((a, b), 1) for a in words for b in words]
    assert len(phrases.CountAutomaton.build(sorted(squares)).final) == 3

"""Collocations, whitening and SimHash balls against brute force, and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cohort.llm import collocations as col
from cohort.llm import nbsvm
from cohort.llm import simhash_balls as balls
from cohort.llm import whitening as white

from .conftest import prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- phrases


def all_phrases(rows, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    return f, n


def plain_collocations(rows, least, top):
    f, n = all_phrases(rows)
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        best = []
        for p, a in frequent.items():
            if any(len(o) > len(p) and b >= a and any(o[i:i + len(p)] == p for i in range(len(o)))
                   for o, b in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k,
                                  counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(rng, n):
    lines = ["New York City, of the one", "the one\tand only thing!", "à la carte; à LA carte x",
             "over and over and over and over", "a.b,c:d\n\n  e f\x0bg\x0c h"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(lines) if rng.random() < 0.4 else prose(rng, rng.randint(0, 30))
                        for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice(["en", "fr", None]), rng.choice([text, text.upper(), None, ""])
                     if rng.random() < 0.3 else text))
    return rows


@pytest.fixture(scope="module")
def spoken():
    return phrase_rows(random.Random(3), 300)


def found_phrases(spark, rows, least, top):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in col.collocations(docs, least=least, top=top).collect())


@pytest.mark.parametrize("least,top", [(3, 2000), (10, 7), (100, 2000)])
def test_collocations_equal_brute_force(spark, spoken, least, top):
    assert found_phrases(spark, spoken, least, top) == plain_collocations(spoken, least, top)


def test_openings_that_fill_a_bucket_are_split(spark, spoken, monkeypatch):
    monkeypatch.setattr(col, "BUCKET", 50)
    monkeypatch.setattr(col, "CHUNK", 2000)
    monkeypatch.setattr(col, "BLOCK", 100)
    docs = spark.createDataFrame(spoken, "lang string, text string").repartition(3)
    phrases, _ = col.frequent_phrases(docs, least=3)
    f, _ = all_phrases(spoken)
    want = {(lang, " ".join(p), len(p), a) for lang, c in f.items() for p, a in c.items() if a >= 3}
    assert {tuple(r) for r in phrases.collect()} == want


def test_routes_below_openings():
    """A phrase that ends at a large opening still counts into it."""
    import pyarrow as pa

    texts = ["x y"] * 3 + ["x y z"] * 2 + ["x y z u v w"]
    batch = pa.record_batch([pa.array(["en"] * 6), pa.array(texts)], names=["lang", "text"])
    run = col._routed(5, 4, [("en", "x y "), ("en", "x y z ")])
    counts = Counter()
    depths = set()
    for out in run(iter([batch])):
        for i in range(out.num_rows):
            depths.add(out.column(2)[i].as_py())
            table = col._sorted_bucket(5, 4)(pa.Table.from_batches([out.slice(i, 1)]))
            for r in table.to_pylist():
                counts[r["phrase"].strip()] += r["n"]
    assert counts["x y"] == 6 and counts["x y z"] == 3 and depths == {2, 3, 4}


def test_collocations_of_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in col.collocations(odd_docs, least=5).collect())
    assert got == plain_collocations(rows, 5, 2000) and got
    assert col.collocations(no_docs).collect() == []


# --- whitening


def plain_fit(vectors):
    x = [tuple(int(np.floor(64 * float(c))) + 1000000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    e, v = np.linalg.eigh(d.T @ d / n)
    return x, n, sums, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("seed,rows,dims", [(1, 300, 24), (2, 60, 5), (3, 40, 17)])
def test_whitening_equals_brute_force(spark, seed, rows, dims):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((rows, dims)) * np.logspace(0, 1, dims)).astype(np.float32)
    vectors[rows // 2:rows // 2 + 9] = vectors[0]
    vectors = vectors.astype(float).tolist()
    x, n, sums, e, v = plain_fit(vectors)
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>")
    got = white.whiten(frame.repartition(5)).collect()
    many = min(16, dims)
    assert len(got) == rows * many
    signs = {}
    for r in sorted(got, key=lambda r: (r["vec_id"], r["component"])):
        row, k = x[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(row, sums))
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(row, sums)])
        plain = centred @ v[:, k] / np.sqrt(e[k])
        sign = signs.setdefault(k, np.sign(plain * r["whitened"]) if abs(plain) > 0.1 else None)
        if sign is None:
            del signs[k]
        assert r["whitened"] == pytest.approx(plain * (sign or np.sign(plain * r["whitened"])),
                                              abs=1e-7)
        assert r["identity_error"] < 1e-9
    assert set(signs) == set(range(many))


@pytest.mark.parametrize("kind", ["iso", "graded", "multiple", "deficient", "diagonal", "wilkinson"])
def test_singular_directions(kind):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((80, 30)))[0]
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    x = {"iso": rng.standard_normal((400, 30)),
         "graded": rng.standard_normal((80, 30)) * np.logspace(0, -6, 30),
         "multiple": q * np.r_[np.full(10, 3.0), np.ones(20)] @ turn,
         "deficient": rng.standard_normal((80, 12)) @ rng.standard_normal((12, 30)),
         "diagonal": np.diag(np.r_[np.full(15, 2.0), np.ones(15)]),
         "wilkinson": np.linalg.cholesky(np.diag(np.abs(np.arange(-15.0, 15))) + 16 * np.eye(30)
                                         + np.eye(30, k=1) + np.eye(30, k=-1)).T}[kind]
    r = np.linalg.qr(x, mode="r")
    squares, v = white.singular_directions(r, 30)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert len(squares) == (12 if kind == "deficient" else 30)
    assert np.allclose(squares, want[:len(squares)], rtol=1e-10)
    assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-9
    assert np.abs(r.T @ (r @ v) - v * squares).max() < 1e-11 * want[0]
    a, b, _ = white.bidiagonalise(r)
    assert np.allclose(white.dqds(a, b)[:len(squares)], want[:len(squares)], rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (0, [0.0, 0.25]), (None, [1.0, 1.0]), (2, [nan, 0.0]), (3, [inf, 0.0]),
            (4, None), (5, [None, 1.0]), (6, []), (7, [1.0]), (8, [2.0]), (9, [1e38, 0.0]),
            (10, [1.0, 0.5])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    vectors = vectors.withColumns({c: F.lit("x") for c in ("id", "x", "dims", "n", "component")})
    rows = white.whiten(vectors).collect()
    by = Counter((r["vec_id"], r["n"]) for r in rows)
    assert by == {(0, 3): 4, (None, 3): 2, (10, 3): 2, (7, 2): 1, (8, 2): 1}
    assert {r["deviation"] for r in rows if r["vec_id"] == 7} == {64 ** 2}
    assert white.whiten(vectors.where("1 = 0")).collect() == []
    assert white.whiten(vectors.where("vec_id = 10")).collect() == []  # no direction


def test_large_entries_stay_exact():
    x = np.array([[2 ** 51, 1], [-2 ** 51, 5]])
    centre = white.Centre(10 ** 6, [3, 7], 2 ** 51)
    assert centre.deviations(x)[0].tolist() == [10 ** 6 * 2 ** 51 - 3, 10 ** 6 - 7]
    assert centre.squares(x) == [None, None]


# --- SimHash


def plain_print(text):
    words = re.findall("[^ \t-\r]+", lower(text))
    grams = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(x):
        return x if root[x] == x else find(root[x])

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "a b", "a b c", "a b c d", "x\x85y z " * 9, "É é É é ÉÉ",
             *(prose(rng, n) for n in (4, 5, 50, 3000))]
    assert [balls.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    monkeypatch.setattr(balls, "PIECE", 40)
    assert [balls.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def some_prints(rng):
    prints = [rng.getrandbits(64) for _ in range(200)]
    for p in prints[:60]:
        for _ in range(3):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << bit
            prints.append(p)
    centre = rng.getrandbits(64)
    for _ in range(300):  # a dense neighbourhood
        prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    return prints + [0, 2 ** 64 - 1, 2 ** 63]


@pytest.mark.parametrize("count,limit", [(2, 1 << 21), (5, 1 << 21), (9, 1 << 21), (3, 5000)])
def test_links_connect_what_lies_near(spark, monkeypatch, count, limit):
    monkeypatch.setattr(balls, "VARIANTS", limit)
    prints = sorted(set(some_prints(random.Random(count))))
    frame = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "print bigint")
    links = balls.links(frame, count=count).collect()
    root = {p: p for p in prints}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = a & 2 ** 64 - 1, b & 2 ** 64 - 1
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    want = plain_components(prints)
    pairs = {}
    for p in prints:
        assert pairs.setdefault(find(p), want[p]) == want[p]
    assert len(pairs) == len(set(want.values()))


def test_flips_cover_each_ball_once():
    groups = balls.groups_of_places(7)
    every = np.concatenate(list(balls.flips(groups).values())).tolist()
    assert len(every) == len(set(every)) == 2081
    assert max(f.bit_count() for f in every) == 2


def test_components_of_documents(spark):
    rng = random.Random(8)
    texts = [prose(rng, 400) for _ in range(30)]
    for t in texts[:10]:
        for _ in range(4):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += ["", None, "...", *texts[:3]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    prints = {i: plain_print(t) for i, t in zip(ids, texts)}
    root = plain_components(prints.values())
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(root[p], i)
    rows = balls.simhash_components(frame.repartition(4)).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == sorted(
        (i, f"{p:016x}", least[root[p]]) for i, p in prints.items())


def test_components_of_odd_rows(odd_docs, no_docs):
    rows = balls.simhash_components(odd_docs.withColumn("print", F.lit("x"))).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == {("0" * 16, 1)}
    assert (("0" * 16), 1) in by[None]
    assert by[6] == {(min(by[7])[0], 6)} and len(by[11]) == 1
    assert balls.simhash_components(no_docs).collect() == []


def test_quality_model_follows_its_method():
    """Indicators of words, ratios and dual steps against plain loops."""
    texts = ["a b b", "b c", "", "c c c a", "d", "a d d b"]
    goal = np.array([1, 0, 1, 0, 1, 0])
    found = [f for _, data, offsets in nbsvm.chunks(pa.array(texts))
             for f in nbsvm.indicators(data, offsets)]
    alone = [f for t in texts for _, data, offsets in nbsvm.chunks(pa.array([t]))
             for f in nbsvm.indicators(data, offsets)]
    assert [f.tolist() for f in found] == [f.tolist() for f in alone] and not len(found[2])
    assert set(found[3]) - set(nbsvm.indicators(*_flat("c a c"))[0]), "c c is an indicator"
    ratios = nbsvm.log_ratios(found, goal)
    size = 1 << nbsvm.BITS
    mass = [size + sum(len(f) for f, g in zip(found, goal) if g == c) for c in (0, 1)]
    for slot in {int(x) for f in found for x in f}:
        n = [1 + sum(slot in f for f, g in zip(found, goal) if g == c) for c in (0, 1)]
        assert abs(ratios[slot] - math.log(n[1] / mass[1] / (n[0] / mass[0]))) < 1e-12
    weights, bias = nbsvm.dual_descent(found, goal, ratios, rounds=400)

    def primal(w, b):
        rows = [ratios[f] / max(np.sqrt((ratios[f] ** 2).sum()), 1e-12) for f in found]
        return 0.5 * (w @ w + b * b) + 0.1 * sum(
            max(0.0, 1 - (1 if g else -1) * (w[f] @ r + b)) for f, r, g in zip(found, rows, goal))

    best, rng = primal(weights, bias), np.random.default_rng(3)
    used = np.unique(np.concatenate(found))
    for scale in (1e-1, 1e-2, 1e-3):
        for _ in range(40):
            step = np.zeros(size)
            step[used] = rng.normal(0, scale, len(used))
            assert primal(weights + step, bias + rng.normal(0, scale)) >= best - 1e-9


def _flat(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])

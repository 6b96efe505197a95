"""Operators against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohort.llm import (bag_minhash, crf_language, impact_index, nbsvm, packing, sanitise,
                        suffix_dedup, textbytes, url_templates, winnowing)
from cohort.operators.skew import join_groups

from .conftest import WORDS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words_of_bytes():
    texts = ["Ab c-É1", "", None, "x" * 5000 + " y", "a", "b c"]
    got = []
    for first, data, offsets in textbytes.chunks(pa.array(texts), 20):
        start, end, rows = textbytes.word_bounds(data, offsets)
        got += [(first + r, bytes(data[a:b]).decode().translate(LOWER))
                for a, b, r in zip(start, end, rows)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]


# --- repeated passages

def brute_repeats(texts, least):
    seen, out = set(), []
    for text in texts:
        data, runs = text.encode(), []
        for p in range(len(data) - least + 1):
            s = data[p:p + least]
            if s in seen:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + least
                else:
                    runs.append([p, p + least])
            seen.add(s)
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + data[at:a], b
        out.append((len(data), sum(b - a for a, b in runs), len(runs),
                    hashlib.sha256(kept + data[at:]).hexdigest()))
    return out


@pytest.mark.parametrize("ranges", [1, 500])
def test_repeats_equal_brute_force(spark, ranges, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE", ranges)
    rng = random.Random(2)
    parts = [prose(rng, 40) for _ in range(6)] + ["a" * 400, "ab" * 200, "é" * 120]
    texts = []
    for _ in range(60):
        texts.append(" ".join(rng.choice(parts)[rng.randint(0, 30):] if rng.random() < 0.6
                              else prose(rng, rng.randint(0, 30)) for _ in range(4)))
    texts += texts[:5] + ["", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r[0]: tuple(r[1:]) for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts, 100)


@given(st.lists(st.binary(min_size=8, max_size=24), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_multikey_sort_finds_equal_strings(strings):
    strings = [s[:8] * 3 for s in strings]
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64)
    for k in (1, 2, 4):
        flat = (flat[:-k] << np.uint64(8 * k)) | flat[k:]
    members, run = suffix_dedup.multikey_sort(
        flat, np.arange(len(strings)) * 24, [0, 8, 16])
    groups = {}
    for m, r in zip(members.tolist(), run.tolist()):
        groups.setdefault(r, set()).add(m)
    want = {}
    for i, s in enumerate(strings):
        want.setdefault(s, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(g) for g in want.values() if len(g) > 1)


# --- urls

def test_url_parts_and_rules(spark):
    urls = ["HTTP://Ex.Example.NET/en/1?a", "https://example.com/de/", "http://a.org/fr/x#y",
            "http://net", "http://x.net/", "nothing", None, "a://b?c://d/e", "x://É.net/EN"]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"),
             ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_templates.url_verdicts(frame, none, rules).collect()}
    assert got == {
        0: ("ex.example.net", "/en/1", "example.net/en/", "allow"),
        1: ("example.com", "/de/", "example.com/de/", "block"),
        2: ("a.org", "/fr/x", "org/fr/", "allow"), 3: ("net", "", None, "allow"),
        4: ("x.net", "/", "net/", "block"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("b", "", None, "allow"),
        8: ("É.net", "/EN", "net/", "block")}


def test_templates_generalise_merge_and_reject(spark):
    rows, bad = [], []
    for i in range(400):
        section = ("news", "blog", "spam")[i % 3]
        rows.append((i, f"http://h.example/{section}/{i}"))
        if i % 2:
            bad.append((i, int(section == "spam")))
    verdicts = url_templates.url_verdicts(
        spark.createDataFrame(rows, "page_id bigint, url string"),
        spark.createDataFrame(bad, "page_id bigint, bad int"), []).collect()
    assert {(r["template"], r["verdict"]) for r in verdicts} == {
        ("/{blog|news}/#", "allow"), ("/spam/#", "block")}


def brute_templates(urls):
    """The template of each (host, segments), by walking the tree of each host."""
    out = {}

    def walk(rows, depth, template):
        groups = {}
        for row in rows:
            groups.setdefault(row[1][depth], []).append(row)
        least = max(3, 0.05 * len(rows))
        shapes = Counter(re.sub("[0-9]+", "#", r[1][depth]) for r in rows)
        parts = {}
        for segment, members in groups.items():
            shape = re.sub("[0-9]+", "#", segment)
            part = (segment if len(members) >= least else
                    shape if shapes[shape] >= least else "*")
            parts.setdefault(part, []).extend(members)
        for part, members in parts.items():
            if len(rows) < 3:
                for r in members:
                    out[r] = (*template, "/".join("*" * (len(r[1]) - depth)))
                continue
            for r in members:
                out[r] = (*template, part)
            further = [r for r in members if len(r[1]) > depth + 1]
            if further:
                walk(further, depth + 1, (*template, part))

    for host in {h for h, _ in urls}:
        walk([(h, p, i) for i, (h, p) in enumerate(urls) if h == host], 0, ())
    return [out[h, p, i] for i, (h, p) in enumerate(urls)]


def brute_branches(counts):
    """{(host, template): branch}, merged from the deepest level up."""
    branch = {k: k[1] for k in counts}
    for d in reversed(range(max(len(t) for _, t in counts))):
        siblings = {}
        for (host, t), b in branch.items():
            if len(b) > d:
                bad, known = counts[host, t]
                old = siblings.setdefault((host, b[:d], b[d + 1:]), {}).get(b[d], (0, 0))
                siblings[host, b[:d], b[d + 1:]][b[d]] = old[0] + bad, old[1] + known
        names = {}
        for at, parts in siblings.items():
            ranked = sorted(((x + 1) / (n + 2), part, n) for part, (x, n) in parts.items())
            groups = [[ranked[0]]]
            for one, two in zip(ranked, ranked[1:]):
                wide = sum(p * (1 - p) / (n + 2) for p, _, n in (one, two)) ** 0.5
                groups[-1].append(two) if (two[0] - one[0]) / wide <= 1 else groups.append([two])
            for group in groups:
                members = sorted(part for _, part, _ in group)
                for part in members:
                    names[at, part] = "{" + "|".join(members) + "}" if members[1:] else part
        branch = {k: b if len(b) <= d else (
            *b[:d], names[(k[0], b[:d], b[d + 1:]), b[d]], *b[d + 1:]) for k, b in branch.items()}
    return branch


def test_verdicts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    deep = "/".join(f"d{i}" for i in range(11))
    urls, bad = [], {}
    for i in range(900):
        host = "hot.example" if i % 3 else f"h{rng.randrange(60)}.example"
        path = rng.choice([f"news/{i}", f"blog/{rng.randrange(9)}/{i}.html", f"spam/{i}/x",
                           f"{deep}/good/{i}", f"{deep}/junk/{i}", "", f"{i}", f"a{i}b/c"])
        urls.append((host, tuple(path.split("/"))))
        if rng.random() < 0.5:
            worse = "spam" in path or "junk" in path
            bad[i] = int(rng.random() < (0.9 if worse else 0.1))
    # nodes of many URLs take the other way
    monkeypatch.setattr(url_templates, "join_groups", lambda *args: join_groups(*args, hot_rows=100)
                        if len(args) > 3 else join_groups(*args, size="n", hot_rows=100))
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_templates.url_verdicts(
        spark.createDataFrame([(i, f"http://{h}/" + "/".join(p)) for i, (h, p) in enumerate(urls)],
                              "page_id bigint, url string"),
        spark.createDataFrame(list(bad.items()), "page_id bigint, bad int"), []).collect()}
    templates, counts = brute_templates(urls), {}
    for i, (h, _) in enumerate(urls):
        x, n = counts.get((h, templates[i]), (0, 0))
        counts[h, templates[i]] = x + bad.get(i, 0), n + (i in bad)
    branch, sums = brute_branches(counts), {}
    for (h, t), (x, n) in counts.items():
        old = sums.get((h, branch[h, t]), (0, 0))
        sums[h, branch[h, t]] = old[0] + x, old[1] + n
    prior = sum(bad.values()) / len(bad)
    for i, (h, p) in enumerate(urls):
        x, n = sums[h, branch[h, templates[i]]]
        s = (x + 2 * prior) / (n + 2)
        block = x and s - 2.33 * (s * (1 - s) / (n + 2)) ** 0.5 >= 2 * prior / (1 + prior)
        assert got[i] == ("/" + "/".join(branch[h, templates[i]]), "block" if block else "allow")
        if h == "hot.example":
            assert got[i][1] == ("block" if {"spam", "junk"} & set(p) else "allow")


# --- personal data

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True,
                    12 <= len(digits) <= 19 and sanitise.luhn(digits),
                    9 <= len(digits) <= 15)[kind]
            if fits:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@given(st.text("a1.@-+ ()9é0%", max_size=50))
@settings(max_examples=500, deadline=None)
def test_patterns_equal_plain_regular_expressions(text):
    assert sanitise.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "@" * 200_000, "+1" + " " * 200_000,
                 "1." * 100_000):
        sanitise.base_spans(text)


def test_disclosing_terms(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(90)]
    for i in range(8):
        texts[i] += " zebulon writes from a@b.example the of"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in sanitise.personal_data(docs).collect()}
    for i, text in enumerate(texts):
        told = {text[s["start"]:s["end"]] for s in rows[i]["spans"] if s["kind"] > 3}
        assert "zebulon" in told if i < 8 else not told
        assert "the" not in told and "of" not in told
        assert [tuple(s) for s in rows[i]["base"]] == brute_spans(text)
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    assert "zebulon" not in clean[0] and "[email]" in clean[0] and clean[9] == texts[9]


def told_words(docs):
    return {r["doc_id"]: {r["text"][s["start"]:s["end"]] for s in r["spans"] if s["kind"] > 3}
            for r in sanitise.personal_data(docs).join(docs, "doc_id").collect()}


def test_rare_words_are_no_evidence_and_copies_count_once(spark):
    rng = random.Random(2)
    texts = [prose(rng, 30) for _ in range(60)]
    texts[0] += " zebulon writes from a@b.example the of"
    texts[1] += " quentin phones +44 20 7946 0958 the of"
    once = told_words(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert not any(once.values())
    near = [(200 + i, f"{texts[1]} {i}") for i in range(9)]  # mostly one look
    copied = list(enumerate(texts)) + [(100 + i, texts[1]) for i in range(20)]
    assert not any(told_words(spark.createDataFrame(
        copied, "doc_id bigint, text string")).values())
    assert not any(told_words(spark.createDataFrame(
        copied + near, "doc_id bigint, text string")).values())


def test_single_terms_follow_their_class_and_parts_count(spark):
    """Where names beside an address keep recurring with it, a name seen once is generalised too;
    a team that always writes from one domain tells a part of its addresses."""
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(400)]
    for i in range(120):
        texts[i] += f" name{'xyzuvw'[i % 6]}{chr(97 + i // 6)} p{i // 6}{'xyzuvw'[i % 6]}@h{i}.example"
        texts[i + 120] += texts[i][texts[i].rindex(" name"):]
    texts[240] += " solitary q@q.example"
    for i in range(8):
        texts[250 + i] += f" {prose(rng, 6)} blueteam m{i}@blue.example"
    told = told_words(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert "solitary" in told[240] and all("blueteam" in told[250 + i] for i in range(8))
    assert not any(told[i] for i in range(260, 400))


def brute_parts(text, spans):
    """(kind, entity, shared part or not) of the entities of a text."""
    out = set()
    for a, k, b in spans:
        value = text[a:b].lower()
        digits = re.sub("[^0-9]", "", value)
        part = (value.split("@")[-1], ".".join(value.split(".")[:2]), digits[:6], digits[:6])[k]
        out |= {(k, value if k < 2 else digits, False), (k, part, True)}
    return out


def brute_told(texts):
    """Per text, the (start, kind, end) of all disclosing terms, by counting pairs one by one."""
    distinct = sorted(set(texts))
    n, held, has, close, looks = len(distinct), {}, {}, set(), {}
    for d, text in enumerate(distinct):
        spans = sanitise.base_spans(text)
        for w in set(words(text)):
            has.setdefault(w, set()).add(d)
        for e in brute_parts(text, spans):
            held.setdefault(e, set()).add(d)
        looks[d] = sanitise.look(text)
        close |= {(d, text[x:y].lower()) for a, _, b in spans
                  for x, y in sanitise.near_words(text, a, b, 5)}
    counted, sums = {}, {True: [0, 0], False: [0, 0]}
    for e, ds in held.items():
        fold = len({looks[d] for d in ds})
        info = math.log(n) if e[2] else math.log(n / fold)
        limit = (fold + 1) / 0.4 - 1 + len(ds) - fold
        if math.log(n / fold) <= max(info * 0.4, 1e-9):
            continue
        for w in {w for d in ds for w in words(brute_masked(distinct[d])) if re.search("[a-z]", w)}:
            both = {d for d in ds if w in words(brute_masked(distinct[d]))}
            if len(has[w]) <= limit:
                k = len({looks[d] for d in both})
                counted[e[2], frozenset(ds), w] = (k, len(has[w]) - len(both) + k - 1, fold, info,
                                                   any((d, w) in close for d in both))
    for k, others, _, _, near in counted.values():
        sums[near][0] += k - 1
        sums[near][1] += others
    out = []
    for text in texts:
        spans, found = sanitise.base_spans(text), set()
        for m in WORD.finditer(text.lower()):
            if any(a < m.end() and m.start() < b for a, _, b in spans):
                continue
            for e in brute_parts(text, spans):
                if (e[2], frozenset(held[e]), m[0]) not in counted:
                    continue
                k, others, fold, info, near = counted[e[2], frozenset(held[e]), m[0]]
                q = (k - 1 + 2 * sums[near][0] / (sums[near][1] + 20)) / (others + 2)
                told = (q * math.log(q * n / fold) / info if q else 0) * (1 if near else 0.9)
                if told >= 0.4:
                    found.add((m.start(), 5 if told >= 0.7 else 4, m.end()))
        best = {(a, b): max(k for x, k, y in found if (x, y) == (a, b)) for a, _, b in found}
        out.append(sorted((a, k, b) for (a, b), k in best.items()))
    return out


def brute_masked(text):
    for a, _, b in sanitise.base_spans(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def test_terms_far_from_an_entity_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, 30) for _ in range(120)]
    for i in range(12):
        texts[i] = (f"Zebulon {texts[i]} zebulon {texts[i]} again{i} {prose(rng, 20)} a@b.example "
                    f"{prose(rng, 20)} closing zebulon")
    texts[12] += f" both c@d.example and a@b.example {prose(rng, 20)} rarely"
    texts[13] += " zebulon"
    for i in range(20, 26):
        texts[i] += f" quorum x{i}@b.example 10.{i % 2}.7.{i} vellum"
    texts += [texts[0]] * 9 + [texts[1] + " tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["spans"] for r in sanitise.personal_data(docs).collect()}
    got = [[tuple(s) for s in rows[i] if s["kind"] > 3] for i in range(len(texts))]
    assert got == brute_told(texts)
    assert [sum(texts[i][a:b].lower() == "zebulon" for a, _, b in got[i])
            for i in range(14)] == [3] * 12 + [0, 0]


def test_training_texts_of_languages_are_distinct(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 20) for _ in range(30)] + ["one text again and again"] * 300
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, lang string")
    fitted, fit = [], crf_language.fit
    monkeypatch.setattr(crf_language, "fit", lambda t, l: fitted.extend(t.to_pylist()) or fit(t, l))
    crf_language.with_languages(docs, F.lit(False))
    assert sorted(fitted) == sorted(set(texts))


# --- near duplicates

def multiset(text):
    w = words(text)
    runs = [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return {r: runs.count(r) for r in set(runs)}


def similarity(a, b):
    both = sum(min(a[x], b.get(x, 0)) for x in a)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


def test_registers_estimate_weighted_similarity():
    rng = random.Random(3)
    one = prose(rng, 200).split()
    two = [w if rng.random() > 0.02 else "zzz" for w in one]
    texts = [" ".join(one + one[:90] * 3), " ".join(two + two[:90] * 2)]
    (_, data, offsets), = textbytes.chunks(pa.array(texts))
    codes = bag_minhash.signatures(*bag_minhash.shingles(data, offsets), 2, 6000)
    true = similarity(*map(multiset, texts))
    assert abs((codes[0] == codes[1]).mean() - true) < 0.03
    exact = bag_minhash.similarities(pa.array(texts[:1]), pa.array(texts[1:]))
    assert abs(exact[0] - true) < 1e-12


def test_signature_of_a_text_does_not_depend_on_its_neighbours():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (1, 3, 5, 50, 700)]
    (_, data, offsets), = textbytes.chunks(pa.array(texts))
    together = bag_minhash.signatures(*bag_minhash.shingles(data, offsets), len(texts), 80)
    for i, t in enumerate(texts):
        (_, data, offsets), = textbytes.chunks(pa.array([t]))
        alone = bag_minhash.signatures(*bag_minhash.shingles(data, offsets), 1, 80)
        assert (alone[0] == together[i]).all()


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "BLOCK", 4)
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        base = prose(rng, 120).split()
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(0, 8)
            texts.append(" ".join(w if rng.random() > n / 120 else "q" for w in base))
    texts += texts[:6] + ["one two", "one two", ""]
    sets = [multiset(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_duplicates(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == [root(i) for i in range(len(texts))]


# --- packing

@given(st.lists(st.integers(1, 300), min_size=1, max_size=200))
@settings(max_examples=60, deadline=None)
def test_bins_hold_what_they_are_given(lengths):
    lengths = sorted(lengths, reverse=True)
    sizes = (64, 128, 300)
    place, used, fitted = packing.pack_lengths(lengths, sizes, lambda c: 20 + c)
    for b in range(len(used)):
        assert used[b] == sum(n for n, p in zip(lengths, place) if p == b)
        assert fitted[b] == min(c for c in sizes if c >= used[b])


def test_packing_keeps_every_token(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, rng.randint(1, 9000)) for i in range(500)],
                                 "doc_id bigint, length int")
    rows = packing.pack(docs, capacities=(512, 1024, 4096), group=120).collect()
    for i, n in ((r[0], r[1]) for r in docs.collect()):
        mine = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]]
        assert sum(n for _, n in mine) == n
    bins = {}
    for r in rows:
        bins.setdefault(r["bin"], []).append(r)
    for members in bins.values():
        spans = sorted((r["offset"], r["length"]) for r in members)
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
        assert {r["used"] for r in members} == {sum(n for _, n in spans)}
        assert members[0]["used"] <= members[0]["capacity"]
    filled = sum(r["length"] for r in rows) / sum(m[0]["capacity"] for m in bins.values())
    assert filled > 0.9


# --- classifiers

def test_forward_backward_equals_a_walk():
    rng = np.random.default_rng(0)
    scores, step = rng.normal(size=(500, 3)), rng.normal(size=(3, 3))
    rows = np.repeat([0, 1, 2, 5], [1, 130, 269, 100])
    post, forward = crf_language.posteriors(scores, rows, step, 16)
    pairs = np.zeros((3, 3))
    for r in set(rows):
        e = scores[rows == r]
        a, b = e.copy(), np.zeros_like(e)
        for t in range(1, len(e)):
            a[t] += np.log(np.exp(a[t - 1][:, None] + step).sum(axis=0))
        for t in range(len(e) - 2, -1, -1):
            b[t] = np.log(np.exp(step + e[t + 1] + b[t + 1]).sum(axis=1))
        for t in range(len(e) - 1):
            z = a[t][:, None] + step + e[t + 1] + b[t + 1]
            z = np.exp(z - z.max())
            pairs += z / z.sum()
        q = np.exp(a + b - (a + b).max(axis=1, keepdims=True))
        assert np.allclose(q / q.sum(axis=1, keepdims=True), post[rows == r], atol=1e-9)
    assert np.allclose(pairs, crf_language._pair_counts(post, forward, rows, step))


def held_out(rows, modulus, value):
    import zlib
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % modulus == value]


def test_languages_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = crf_language.with_languages(docs, mark).select("doc_id", "lang", "predicted.*")
    tested = held_out(rows.collect(), 4, 2)
    assert sum(r["lang"] == r["lang_pred"] for r in tested) > 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in tested)


def test_code_switching_is_labelled_in_runs():
    rng = random.Random(8)
    other = [w[::-1] + "eau" for w in WORDS]
    texts = [prose(rng, 60) for _ in range(40)] + [
        " ".join(rng.choice(other) for _ in range(60)) for _ in range(40)]
    model = crf_language.fit(pa.array(texts), ["en"] * 40 + ["xx"] * 40)
    mixed = prose(rng, 30) + " " + " ".join(rng.choice(other) for _ in range(10))
    (name,), (share,) = crf_language.label_texts(model, pa.array([mixed]))
    assert name == "en" and 0.65 < share < 0.85


def test_quality_of_held_out_documents(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = held_out(nbsvm.quality_scores(docs, labels, mark).collect(), 3, 1)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [r["score"] for r in rows if truth.get(r["doc_id"]) == 1]
    poor = [r["score"] for r in rows if truth.get(r["doc_id"]) == 0]
    wins = np.mean([(g > p) + 0.5 * (g == p) for g in good for p in poor])
    assert wins > 0.95


# --- exact search

def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(impact_index, "BLOCK", 150)
    monkeypatch.setattr(impact_index, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.12, (600, 24))
    vectors[100:140] = vectors[50] + rng.normal(0, 0.01, (40, 24))
    vectors[200:220] = vectors[60]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in impact_index.top_inner_products(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 600, 50):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert set(got) == set(range(0, 600, 50))


# --- benchmark passages

def test_contamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice((3, 7, 9, 10, 11, 40)))) for i in range(12)]
    items += [(20, ""), (21, None), (22, items[5][1]), (23, "Only THREE words")]
    texts = []
    for i in range(80):
        parts = [prose(rng, rng.randint(0, 25))]
        if i % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            a = rng.randint(0, max(0, len(w) - 12))
            parts += [" ".join(w[a:a + rng.randint(8, 30)]).upper(), prose(rng, 5)]
        texts.append(" -- ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in winnowing.contamination(docs, bench).collect()}
    found = 0
    for i, text in enumerate(texts):
        w, hit, names = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            m = min(10, len(p))
            runs = {tuple(p[k:k + m]) for k in range(len(p) - m + 1)} if p else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k:k + m]) in runs:
                    hit |= set(range(k, k + m))
                    names.add(str(item))
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["items"]) == (
            len(w), len(hit), sorted(names))
        found += bool(hit)
    assert 10 < found < 80


def test_long_constant_text_is_sorted_in_bounded_steps():
    import numpy as np
    import pyarrow as pa

    text = "a" * 300_000
    batch = pa.record_batch([pa.array([1]), pa.array([9]), pa.array([text]),
                             pa.array([list(range(300_000))])], names=["id", "tkey", "text", "at"])
    n = size = 0
    for out in suffix_dedup._suffixes(100, 32)(iter([batch])):
        n, size = n + out.num_rows, max(size, out.column(4).nbytes)
    assert n == 300_000 - 99 and size < 8_000_000
    rows = suffix_dedup._suffixes(100, 32)(iter([batch.slice(0, 1)]))
    removed = np.zeros(300_000, bool)
    going = 0
    for out in suffix_dedup._bucket(100)(rows):
        for low, high, digest in zip(*(out.column(k).to_pylist() for k in (2, 3, 4))):
            if digest is None:
                removed[low:high] = True
            else:
                going += 1
    assert removed[200:].all() and 0 < going < 100  # one per run, for the comparison across runs

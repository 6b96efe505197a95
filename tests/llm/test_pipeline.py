"""The corpus pipeline from raw rows to sequences, against plain versions of its stages."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .conftest import prose

GERMAN = ("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
          "an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über").split()


def runs(text):
    words = text.lower().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


def near(a, b):
    x, y = runs(a), runs(b)
    return sum((x & y).values()) >= 0.8 * sum((x | y).values())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = prose(rng, 40)
    texts = [prose(rng, rng.randint(80, 200)) for _ in range(40)]
    texts += [" ".join(rng.choice(GERMAN) for _ in range(120)) for _ in range(20)]
    for t in texts[:5]:  # near copies: one word in a hundred differs
        words = t.split()
        texts.append(" ".join([*words[:-1], "other"]))
    texts += [texts[7]] * 3
    texts.append(prose(rng, 50) + " " + item + " " + prose(rng, 50))
    texts.append(prose(rng, 90) + " write to jane.doe@mail.example.org or 10.1.2.3 " + prose(rng, 40))
    texts += ["... 123", "", None, "long " + prose(rng, 16_000)]
    ids = list(range(len(texts)))
    ids[3] = None
    rows = [(i, t, "de" if k in range(40, 60) else "en", "s", len(t or ""), "x", 1, 2)
            for k, (i, t) in enumerate(zip(ids, texts))]
    rows.append(rows[10])  # a row twice
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                 "n_chars bigint, predicted string, r1 int, clean int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder, texts, ids, item


def test_stages_and_sequences(spark, corpus):
    folder, texts, ids, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after.append(corpus_pipeline.written(stage(spark, after[-1], folder), "stage"))
        assert after[-1].columns == docs.columns
        assert after[-1].where("predicted = 'x' AND r1 = 1 AND clean = 2").count() == \
            after[-1].count()
    kept = [[(r.doc_id, r.text) for r in a.collect()] for a in after]
    assert Counter(kept[1]) == Counter(
        (i, t) for i, t in kept[0] if any(c.isalpha() for c in t or ""))
    classes = []
    for row in sorted(set(kept[1]), key=lambda r: (r[0] is not None, r[0] or 0)):
        if not any(near(row[1], other[1]) for other in classes):
            classes.append(row)
    assert Counter(kept[2]) == Counter(classes)
    gone = [r for r in kept[2] if item in r[1]]
    assert gone and Counter(kept[3]) == Counter(r for r in kept[2] if r not in gone)
    assert sorted(i or -1 for i, _ in kept[4]) == sorted(i or -1 for i, _ in kept[3])
    assert not any("jane.doe" in t or "10.1.2.3" in t for _, t in kept[4])
    assert all(r.n_chars == len(r.text) for r in after[4].collect())

    sequences = corpus_pipeline.STAGES[-1][1](spark, after[4], folder).collect()
    found = {}
    for s in sequences:
        assert s.used == sum(p.length for p in s.pieces) <= s.capacity
        assert [p.offset for p in s.pieces] == [sum(q.length for q in s.pieces[:k])
                                                for k in range(len(s.pieces))]
        for p in s.pieces:
            found.setdefault(p.doc_id, []).append((p.start, p.length, bytes(p.bytes)))
    built = sorted((i or -1, b"".join(b for _, _, b in sorted(parts)).decode())
                   for i, parts in found.items())
    assert built == sorted((i or -1, t) for i, t in kept[4])
    assert max(len(p) for p in found.values()) > 1  # the long text is cut


def test_run_equals_its_stages(spark, corpus):
    folder = corpus[0]
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["bin", "capacity", "used", "pieces", "doc_ids"]
    assert rows.agg(F.sum("used")).first()[0] > 16_000

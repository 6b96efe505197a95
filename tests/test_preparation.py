import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import catalog, prep


def labelled(spark, n=400):
    return spark.range(n).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b")
                                 .alias("label"))


def test_dictionary_is_alphabetical():
    assert list(catalog.CLASS_TO_IDX.values()) == list(range(4))
    assert sorted(catalog.CLASS_TO_IDX) == list(catalog.CLASS_TO_IDX)


def test_unknown_classes_are_left_out_and_listed(spark):
    rows = spark.createDataFrame([("glioma",), ("junk",), ("junk",)], "label string")
    assert [r.label_idx for r in catalog.encode_labels(rows, catalog.CLASS_TO_IDX).collect()] == [0]
    assert [tuple(r) for r in catalog.unknown_classes(rows, catalog.CLASS_TO_IDX).collect()] == [
        ("junk", 2)]


def test_balanced_weights_are_one_and_absent_classes_count_as_one(spark):
    rows = spark.range(8).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    weights = {r.label: r.weight for r in prep.class_weights(rows, ["a", "b"]).collect()}
    assert weights == {"a": 1.0, "b": 1.0}
    assert {r.label: r.weight for r in prep.class_weights(rows, ["a", "b", "c", "d"]).collect()
            } == {"a": 0.5, "b": 0.5, "c": 2.0, "d": 2.0}


def test_resample_evens_out_classes(spark):
    rows = labelled(spark)
    drawn = prep.weighted_resample(rows, "id", ["a", "b", "none"], draws=3000)
    assert drawn.count() == 3000
    counts = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    assert abs(counts["a"] - 1500) < 150
    assert drawn.join(rows, ["id", "label"]).count() == 3000
    assert drawn.select("id").distinct().count() > 350
    again = prep.weighted_resample(rows.repartition(3), "id", ["a", "b", "none"], draws=3000)
    assert sorted(drawn.collect()) == sorted(again.collect())


def test_batches(spark):
    rows = labelled(spark, 70)
    kept = prep.batches(rows, "id", 32)
    assert [r["count"] for r in kept.groupBy("batch_id").count().orderBy("batch_id").collect()
            ] == [32, 32, 6]
    assert prep.batches(rows, "id", 32, drop_last=True).count() == 64
    other = prep.shuffled(rows, "id", epoch=1).orderBy("position").collect()
    assert [r.id for r in other] != [r.id for r in
                                     prep.shuffled(rows, "id").orderBy("position").collect()]


@pytest.mark.parametrize("alpha", [0, 0.2, 1.0])
def test_mixup(spark, alpha):
    vectors = spark.range(64).select("id", (F.col("id") % 3).alias("label"), F.array(
        F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    rows = prep.mixup(prep.batches(vectors, "id", 16), "id", "x", alpha=alpha).collect()
    assert len(rows) == 64
    for r in rows:
        assert r.mixed[0] == pytest.approx(r.lam * r.id + (1 - r.lam) * r.partner)
        assert r.mixed[1] == pytest.approx(1) and 0 <= r.lam <= 1
        assert (r.label_a, r.label_b) == (r.id % 3, r.partner % 3)
    assert len({(r.batch_id, r.lam) for r in rows}) == 4
    assert sorted(r.partner for r in rows) == list(range(64))
    if alpha == 0:
        assert all(r.lam == 1 and r.mixed[0] == r.id for r in rows)


def test_sample_and_examples(spark):
    rows = labelled(spark)
    sample = catalog.seeded_sample(rows, "id", 20)
    assert sorted(sample.collect()) == sorted(
        catalog.seeded_sample(rows.repartition(5), "id", 20).collect())
    assert [r.id for r in catalog.first_examples(rows, 2, ["label"], "id").orderBy("id")
            .collect()] == [0, 1, 2, 4]
    totals = catalog.split_by_class(rows.withColumn("split", F.lit("train")),
                                    ["train", "val"], ["a", "b"])
    got = {(r.split, r.label): (r.n, r.pct) for r in totals.collect()}
    assert got[("train", "a")] == (100, 25.0) and got[("val", "b")] == (0, None)
    assert got[(None, None)] == (400, 100.0) and len(got) == 9
    assert np.isclose(sum(r.pct for r in catalog.class_distribution(rows).collect()), 100)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import metrics, trainlog

# Published confusion matrices (rows = true class), accuracy and macro F1.
PUBLISHED = {
    "custom_cnn": ([[228, 31, 8, 3], [16, 218, 11, 25], [2, 11, 246, 11], [5, 11, 1, 253]],
                   0.8750, 0.8749),
    "resnet_scratch": ([[259, 7, 1, 3], [6, 254, 1, 9], [6, 1, 259, 4], [0, 1, 0, 269]],
                       0.9639, 0.9639),
    "mobilenet_scratch": ([[257, 10, 2, 1], [7, 260, 2, 1], [3, 7, 255, 5], [1, 0, 0, 269]],
                          0.9639, 0.9639),
    "resnet_pretrained": ([[263, 5, 1, 1], [11, 257, 0, 2], [5, 5, 257, 3], [2, 0, 0, 268]],
                          0.9676, 0.9676),
    "efficientnet_pretrained": ([[260, 9, 0, 1], [1, 269, 0, 0], [2, 2, 259, 7], [0, 3, 0, 267]],
                                0.9769, 0.9769),
}


def expanded(spark, matrix):
    cells = [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    return spark.createDataFrame(cells, "label int, pred int, n int").select(
        "label", "pred", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


@pytest.mark.parametrize("name", PUBLISHED)
def test_published_figures_follow_from_their_matrix(spark, name):
    matrix, accuracy, f1 = PUBLISHED[name]
    rows = expanded(spark, matrix)
    classes = metrics.per_class(metrics.confusion(rows, range(4)))
    summary = metrics.averages(classes).first()
    assert round(summary.accuracy, 4) == accuracy and round(summary.f1_macro, 4) == f1
    m = np.array(matrix)
    for r in classes.collect():
        tp, actual, predicted = m[r["class"], r["class"]], m[r["class"]].sum(), m[:, r["class"]].sum()
        assert r.recall == pytest.approx(tp / actual)
        assert r.precision == pytest.approx(tp / predicted)
        assert r.specificity == pytest.approx(
            (m.sum() - actual - predicted + tp) / (m.sum() - actual))


def test_empty_classes_give_zero_and_leave_macro_f1_alone(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    cm = metrics.confusion(rows, range(3))
    assert cm.count() == 9
    classes = metrics.per_class(cm)
    empty = classes.where("class = 2").first()
    assert (empty.precision, empty.recall, empty.f1, empty.support) == (0, 0, 0, 0)
    assert metrics.averages(classes).first().f1_macro == pytest.approx(2 / 3)
    assert {r["row"] for r in metrics.report(classes).collect()} == {
        "0", "1", "accuracy", "macro avg", "weighted avg"}
    shares = {(r.label, r.pred): r.share for r in metrics.confusion_shares(cm).collect()}
    assert shares[(0, 1)] == 0.5 and shares[(2, 0)] is None


def scored(spark, labels, scores):
    return spark.createDataFrame(
        [(i, int(y), [1 - s, s]) for i, (y, s) in enumerate(zip(labels, scores))],
        "id int, label int, probs array<double>")


def slow_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_auc_and_roc_with_ties(spark, ranges):
    rng = random.Random(3)
    labels = [rng.random() < 0.4 for _ in range(300)]
    scores = [round(min(1, max(0, 0.3 * y + rng.random() * 0.7)), 2) for y in labels]
    points = metrics.curve_points(
        metrics.score_counts(scored(spark, labels, scores), (0, 1)), ranges=ranges)
    aucs = {r["class"]: r.auc for r in metrics.auc_per_class(points).collect()}
    assert aucs[1] == pytest.approx(slow_auc(labels, scores))
    assert aucs[0] == pytest.approx(aucs[1])
    assert metrics.macro_auc(metrics.auc_per_class(points), 2).first().auc_macro == pytest.approx(
        aucs[1])
    curve = sorted((r.fpr, r.tpr) for r in metrics.roc_points(points).collect()
                   if r["class"] == 1)
    assert curve[0] == (0, 0) and curve[-1] == (1, 1)
    xs, ys = zip(*curve)
    assert np.trapezoid(ys, xs) == pytest.approx(aucs[1])
    best = {r["class"]: r.tpr for r in metrics.operating_point(
        metrics.roc_points(points), 0.2).collect()}
    assert best[1] == max(y for x, y in curve if x <= 0.2)


def test_collinear_points_are_removed(spark):
    points = metrics.curve_points(metrics.score_counts(
        scored(spark, [1, 1, 1, 0, 0, 0], [.9, .8, .7, .3, .2, .1]), (0, 1)))
    curve = sorted((r.fpr, r.tpr) for r in metrics.roc_points(points).collect()
                   if r["class"] == 1)
    assert curve == [(0, 0), (0, pytest.approx(1 / 3)), (0, 1), (1, 1)]


def test_one_sided_class_has_no_auc(spark):
    points = metrics.curve_points(metrics.score_counts(scored(spark, [1, 1], [.4, .6]), (0, 1)))
    aucs = metrics.auc_per_class(points)
    assert all(r.auc is None for r in aucs.collect())
    assert metrics.macro_auc(aucs, 2).first().auc_macro is None
    assert {r.auc for r in metrics.zero_filled(aucs).collect()} == {0.0}
    assert metrics.roc_points(points).isEmpty()


def test_score_bins_bound_the_result(spark):
    rows = scored(spark, [0, 1] * 50, [i / 100 for i in range(100)])
    assert metrics.score_counts(rows, (0, 1), score_bins=4).count() <= 10


def test_scoring(spark):
    row = metrics.score_logits(spark.createDataFrame(
        [([2.0, 0.5, 0.1, 0.3],)], "logits array<double>"), list("abcd")).first()
    expected = np.exp([2.0, 0.5, 0.1, 0.3]) / np.exp([2.0, 0.5, 0.1, 0.3]).sum()
    assert row.probs == pytest.approx(expected.tolist()) and row.prediction == "a"
    assert row.confidence == pytest.approx(expected.max())
    assert sum(row.probabilities.values()) == pytest.approx(1)


def test_log_loss_and_worst_errors(spark):
    rows = spark.createDataFrame([(1, 0, 0, .8, [.8, .2]), (2, 1, 0, .6, [.6, .4]),
                                  (3, 1, 0, .9, [.9, .1])],
                                 "id int, label int, pred int, confidence double, "
                                 "probs array<double>")
    losses = -np.log([.8, .4, .1])
    assert metrics.log_loss(rows).first().log_loss == pytest.approx(losses.mean())
    weights = spark.createDataFrame([(0, 3.0), (1, 1.0)], "label int, weight double")
    assert metrics.log_loss(rows, weights).first().log_loss == pytest.approx(
        np.average(losses, weights=[3, 1, 1]))
    assert [r.id for r in metrics.worst_errors(rows, 5).collect()] == [3, 2]


def test_log_loss_keeps_rows_of_probability_zero(spark):
    rows = spark.createDataFrame([(0, [.9, .1], [3.0, 0.8]), (1, [1.0, 0.0], [900.0, 0.0])],
                                 "label int, probs array<double>, logits array<double>")
    assert metrics.log_loss(rows.drop("logits"), floor=1e-10).first().log_loss == pytest.approx(
        (-np.log(.9) - np.log(1e-10)) / 2)
    assert metrics.log_loss(rows).first().log_loss == pytest.approx(
        (np.log(1 + np.exp(-2.2)) + 900.0) / 2)


def naive_stop(scores, patience, delta, mode):
    best, waited = None, 0
    for epoch, s in enumerate(scores, 1):
        if best is None or (s > best + delta if mode == "max" else s < best - delta):
            best, waited = s, 0
        else:
            waited += 1
            if waited >= patience:
                return epoch
    return None


@pytest.mark.parametrize("mode", ["max", "min"])
def test_early_stop_equals_the_loop(spark, mode):
    rng = random.Random(1)
    runs = {f"r{i}": [rng.random() * 0.01 + e * 0.0005 for e in range(rng.randint(3, 30))]
            for i in range(40)}
    rows = [(run, e, s) for run, scores in runs.items() for e, s in enumerate(scores, 1)]
    rng.shuffle(rows)
    history = spark.createDataFrame(rows, "run string, epoch int, val_f1_macro double")
    found = {r.run: (r.epochs, r.stopped) for r in
             trainlog.early_stops(history, patience=4, min_delta=0.002, mode=mode).collect()}
    assert found == {run: (len(s), naive_stop(s, 4, 0.002, mode)) for run, s in runs.items()}
    with pytest.raises(ValueError):
        trainlog.early_stops(history, mode="up")


def test_a_run_can_stop_on_its_best_epoch(spark):
    """The checkpoint rule has no margin, the stopping rule has one."""
    scores = [0.9] + [0.9 + i * 0.0001 for i in range(1, 8)]
    history = spark.createDataFrame([("r", e, s) for e, s in enumerate(scores, 1)],
                                    "run string, epoch int, val_f1_macro double")
    assert trainlog.early_stops(history).first().stopped == 8
    assert trainlog.best_epoch(history).first().epoch == 8
    flat = history.withColumn("val_f1_macro", F.lit(0.5))
    assert trainlog.best_epoch(flat).first().epoch == 1

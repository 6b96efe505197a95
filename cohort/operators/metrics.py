"""Evaluation tables from predictions.

Everything but the score curves derives from the confusion counts: one shuffle of at most
classes x classes rows per task.  Curves work on distinct scores and cut them into ranges, so no
class is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.vectors import arg_max, ranked, softmax
from cohort.session import written

LOW_RECALL = 0.90
LOW_SPECIFICITY = 0.90
SCORE_RANGES = 64


def score_logits(df: DataFrame, class_names: Sequence[str], logits: str = "logits") -> DataFrame:
    """Add ``probs``, ``pred``, ``prediction``, ``confidence`` and the class-to-probability map."""
    names = F.array(*[F.lit(c) for c in class_names])
    return (df.withColumn("probs", softmax(F.col(logits)))
            .withColumn("pred", arg_max(F.col("probs")))
            .withColumns({"prediction": names[F.col("pred")],
                          "confidence": F.array_max("probs"),
                          "probabilities": F.map_from_arrays(names, F.col("probs"))}))


def ranked_probabilities(df: DataFrame, class_names: Sequence[str], key: str) -> DataFrame:
    """One row per input row and class, most likely class first."""
    names = F.array(*[F.lit(c) for c in class_names])
    pairs = F.posexplode(ranked(names, F.col("probs"))).alias("pos", "entry")
    return df.select(key, pairs).select(
        key, (F.col("pos") + 1).alias("place"), F.col("entry.name").alias("class"),
        F.col("entry.score").alias("prob"))


def confusion(predictions: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Counts for all class pairs, zeros included: label, pred, n."""
    by = list(by)
    counts = predictions.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    groups = counts.select(*by).distinct() if by else predictions.sparkSession.range(1).select()
    values = F.array(*[F.lit(c) for c in classes])
    cells = groups.withColumn("label", F.explode(values)).withColumn("pred", F.explode(values))
    return (cells.join(counts, [*by, "label", "pred"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def confusion_shares(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row-normalised matrix; NULL for a class without rows."""
    row = Window.partitionBy(*by, "label")
    return cm.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(row)))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def per_class(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, specificity and support per class; 0 on an empty denominator."""
    by = list(by)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("s")
    sums = (cm.select(*by, sides).groupBy(*by, F.col("s.class").alias("class"))
            .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
                 F.sum("s.tp").alias("tp")))
    total = F.sum("support").over(Window.partitionBy(*by))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    negatives = total - support
    return (sums.withColumns({"precision": _ratio(tp, predicted), "recall": _ratio(tp, support),
                              "f1": _ratio(2 * tp, support + predicted),
                              "specificity": _ratio(negatives - (predicted - tp), negatives)}))


def averages(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1.

    Macro F1 is over classes that occur among labels or predictions.
    """
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"))


def report(classes: DataFrame) -> DataFrame:
    """Classification report: one row per class, then accuracy, macro and weighted averages."""
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    support, figures = F.col("support"), ["precision", "recall", "f1"]
    rows = classes.where(present).select(F.col("class").cast("string").alias("row"), *figures,
                                         "support")
    overall = F.sum("tp") / F.sum("support")
    nothing = F.lit(None).cast("double")
    total = F.sum("support").alias("support")
    share = [(F.sum(F.col(c) * support) / F.sum("support")).alias(c) for c in figures]
    return (rows.unionByName(classes.agg(
                F.lit("accuracy").alias("row"), nothing.alias("precision"),
                nothing.alias("recall"), overall.alias("f1"), total))
            .unionByName(classes.where(present).agg(
                F.lit("macro avg").alias("row"), *[F.avg(c).alias(c) for c in figures], total))
            .unionByName(classes.agg(F.lit("weighted avg").alias("row"), *share, total)))


def clinical_flags(classes: DataFrame) -> DataFrame:
    """Recall and specificity warnings per class, and whether all recalls are good."""
    low = F.col("recall") < LOW_RECALL
    everything = Window.partitionBy()
    return classes.select(
        "class", "recall", "specificity",
        F.when(low, "risk of missed diagnoses").alias("recall_flag"),
        F.when(F.col("specificity") < LOW_SPECIFICITY, "elevated false positive rate")
        .alias("specificity_flag"),
        F.bool_and(~low).over(everything).alias("all_recall_good"))


def score_counts(predictions: DataFrame, classes: Sequence, by: Sequence[str] = (),
                 score_bins: int | None = None) -> DataFrame:
    """Positives and negatives at every distinct score of every class (one against the rest).

    ``score_bins`` rounds the scores down to that many steps, which bounds the result.
    """
    by = list(by)
    names = F.array(*[F.lit(c) for c in classes])
    score = F.col("score")
    if score_bins:
        score = F.floor(score * score_bins) / F.lit(float(score_bins))
    cells = predictions.select(*by, "label", F.posexplode("probs").alias("pos", "score"))
    own = F.col("label") == F.col("class")
    return (cells.withColumn("class", names[F.col("pos")])
            .groupBy(*by, "class", score.alias("score"))
            .agg(F.count_if(own).alias("pos"), F.count_if(~own).alias("neg")))


def curve_points(counts: DataFrame, by: Sequence[str] = (),
                 ranges: int = SCORE_RANGES) -> DataFrame:
    """Running true and false positives per class from the highest score down.

    The distinct scores of a class are cut at approximate quantiles into ranges of about equal
    size.  The cuts are read once (classes x ranges numbers) so that every later step uses the
    same ones; running sums go inside each range and start from the totals of the ranges above.
    Also gives the counts at the next lower score, for the removal of collinear points.
    """
    keys = [*by, "class"]
    counts = written(counts, "score-counts")
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    quantiles = counts.groupBy(*keys).agg(F.percentile_approx("score", steps, 10_000)
                                          .alias("cuts"))
    cuts = counts.sparkSession.createDataFrame(quantiles.collect(), quantiles.schema)
    above_cuts = F.size(F.filter("cuts", lambda c: c < F.col("score")))
    ranged = (counts.join(F.broadcast(cuts), keys)
              .withColumn("_range", above_cuts).drop("cuts"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_range"))
    higher = down.rowsBetween(Window.unboundedPreceding, -1)
    of_class = Window.partitionBy(*keys)
    top = F.max_by(F.struct("pos", "neg"), "score")
    totals = (ranged.groupBy(*keys, "_range")
              .agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), top.alias("_top"))
              .withColumns({
                  "_pos_above": F.coalesce(F.sum("_pos").over(higher), F.lit(0)),
                  "_neg_above": F.coalesce(F.sum("_neg").over(higher), F.lit(0)),
                  "positives": F.sum("_pos").over(of_class),
                  "negatives": F.sum("_neg").over(of_class),
                  "_below": F.lead("_top").over(down)})
              .drop("_pos", "_neg", "_top"))
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc("score"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("_below"))
    return (ranged.join(totals, [*keys, "_range"])
            .withColumns({"tp": F.sum("pos").over(running) + F.col("_pos_above"),
                          "fp": F.sum("neg").over(running) + F.col("_neg_above"),
                          "following": following})
            .drop("_range", "_pos_above", "_neg_above", "_below"))


def auc_per_class(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest area under the curve, ties counted half; NULL if a side is empty."""
    p, n = F.first("positives").cast("double"), F.first("negatives").cast("double")
    beaten = F.col("negatives") - F.col("fp") + F.col("neg") / 2.0
    return points.groupBy(*by, "class").agg(
        F.try_divide(F.sum(F.col("pos") * beaten), p * n).alias("auc"))


def macro_auc(aucs: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over classes, NULL as soon as one class has no value."""
    return aucs.groupBy(*by).agg(
        F.when(F.count("auc") == classes, F.avg("auc")).alias("auc_macro"))


def zero_filled(aucs: DataFrame) -> DataFrame:
    """Report form: a missing AUC shows as 0."""
    return aucs.withColumn("auc", F.coalesce("auc", F.lit(0.0)))


def roc_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC per class from (0, 0) on, without points that lie on a straight line.

    Classes with an empty side have no curve.
    """
    keys = [*by, "class"]
    usable = points.where((F.col("positives") > 0) & (F.col("negatives") > 0))
    is_first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bends = ((F.col("following.pos") != F.col("pos")) | (F.col("following.neg") != F.col("neg")))
    kept = usable.where(is_first | F.col("following").isNull() | bends)
    point = F.struct(F.col("score").alias("threshold"),
                     (F.col("fp") / F.col("negatives")).alias("fpr"),
                     (F.col("tp") / F.col("positives")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                      F.lit(0.0).alias("tpr"))
    both = F.explode(F.when(is_first, F.array(origin, point)).otherwise(F.array(point)))
    return kept.select(*keys, both.alias("p")).select(*keys, "p.*")


def operating_point(roc: DataFrame, max_fpr: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Best true positive rate whose false positive rate does not exceed ``max_fpr``."""
    return roc.where(F.col("fpr") <= max_fpr).groupBy(*by, "class").agg(
        F.max("tpr").alias("tpr"))


def worst_errors(predictions: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The ``k`` wrong predictions with the highest confidence."""
    wrong = predictions.where(F.col("pred") != F.col("label"))
    return wrong.orderBy(F.desc("confidence"), key).limit(k)


def log_loss(predictions: DataFrame, weights: DataFrame | None = None,
             by: Sequence[str] = (), floor: float = 1e-15) -> DataFrame:
    """Cross-entropy of the true class; with class weights, the weighted mean.

    Taken from ``logits`` where the predictions have them, as the log of the sum of their
    exponentials less that of the true class.  Without them a probability below ``floor`` counts
    as ``floor``: its row has a large loss and is not lost.  ``weights`` (label, weight) has one
    row per class.
    """
    if "logits" in predictions.columns:
        top = F.array_max("logits")
        spread = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))
        loss = F.ln(spread) + top - F.col("logits")[F.col("label")]
    else:
        loss = -F.ln(F.greatest(F.col("probs")[F.col("label")], F.lit(floor)))
    if weights is None:
        return predictions.groupBy(*by).agg(F.avg(loss).alias("log_loss"))
    weighted = predictions.join(F.broadcast(weights), "label")
    return weighted.groupBy(*by).agg(
        (F.sum(F.col("weight") * loss) / F.sum("weight")).alias("log_loss"))


def model_comparison(predictions: DataFrame, classes: Sequence, by: str = "model") -> DataFrame:
    """One row per model: accuracy, macro F1, macro AUC and the F1 of every class.

    Models without predictions do not appear.
    """
    figures = per_class(confusion(predictions, classes, [by]), [by])
    aucs = auc_per_class(curve_points(score_counts(predictions, classes, [by]), [by]), [by])
    wide = figures.groupBy(by).pivot("class", list(classes)).agg(F.first("f1"))
    wide = wide.select(by, *[F.col(f"`{c}`").alias(f"f1_{c}") for c in classes])
    return (averages(figures, [by]).drop("f1_weighted")
            .join(macro_auc(aucs, len(classes), [by]), by).join(wide, by))


def metric_document(classes: DataFrame, aucs: DataFrame) -> DataFrame:
    """One row: summary figures and a map from class to its metrics."""
    rows = classes.join(aucs, "class", "left")
    entry = F.struct(
        F.col("class").cast("string").alias("key"),
        F.struct("precision", "recall", F.col("recall").alias("sensitivity"), "specificity",
                 "f1", "support", F.coalesce("auc", F.lit(0.0)).alias("roc_auc")).alias("value"))
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    return rows.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("roc_auc_macro"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_class"))

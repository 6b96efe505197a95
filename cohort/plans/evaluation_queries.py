"""Metric and training-log queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohort.operators import metrics, prep, trainlog
from cohort.plans.inputs import (CONFUSION_SQL, HISTORY_SQL, TOPICS, history, predictions,
                                 predictions_sql, rounded, table)
from cohort.plans.registry import ORACLE, query
from cohort.session import scratch_path
from cohort.sources import tables

TOPIC_NAMES = tuple(f"topic{i}" for i in TOPICS)
MODELS = {"all": (0, 64), "back": (32, 64), "front": (0, 32)}


def _confusion(spark, folder):
    return metrics.confusion(predictions(spark, folder), TOPICS)


def _per_class(spark, folder):
    return metrics.per_class(_confusion(spark, folder))


@query("m1_scores", f"""WITH {predictions_sql()}
SELECT id, pred, 'topic' || pred AS prediction, round(confidence, 4) AS confidence,
  round(probs[1], 4) AS topic0, round(probs[10], 4) AS topic9 FROM pred""")
def scores(spark, folder):
    scored = metrics.score_logits(
        predictions(spark, folder).select("id", "logits"), TOPIC_NAMES)
    return scored.select(
        "id", "pred", "prediction",
        F.round(F.round("confidence", 6), 4).alias("confidence"),
        F.round(F.round(F.col("probabilities")["topic0"], 6), 4).alias("topic0"),
        F.round(F.round(F.col("probabilities")["topic9"], 6), 4).alias("topic9"))


@query("m19_ranked_probabilities", f"""WITH {predictions_sql()},
cell AS (SELECT id, unnest(range(10)) AS c, unnest(probs) AS prob FROM pred)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY prob DESC, 'topic' || c)::INT AS place,
  'topic' || c AS class, prob FROM cell""")
def ranked_probabilities(spark, folder):
    return metrics.ranked_probabilities(predictions(spark, folder), TOPIC_NAMES, "id")


@query("m2_accuracy", f"""WITH {predictions_sql()}
SELECT round(avg((label = pred)::INT), 6) AS accuracy FROM pred""")
def accuracy(spark, folder):
    return rounded(metrics.accuracy(predictions(spark, folder)), "accuracy")


@query("m3_confusion", f"WITH {CONFUSION_SQL} SELECT label, pred, n FROM cm")
def confusion(spark, folder):
    return _confusion(spark, folder)


@query("m4_confusion_norm", f"""WITH {CONFUSION_SQL}
SELECT label, pred, n, round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY label), 0), 6)
  AS share FROM cm""")
def confusion_shares(spark, folder):
    return rounded(metrics.confusion_shares(_confusion(spark, folder)), "share")


@query("m5_per_class", f"""WITH {CONFUSION_SQL}
SELECT class, support, predicted, tp, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per_class""")
def per_class(spark, folder):
    return rounded(_per_class(spark, folder).drop("specificity"), "precision", "recall", "f1")


@query("m6_averages", f"""WITH {CONFUSION_SQL}
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
  round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS f1_macro,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM per_class""")
def averages(spark, folder):
    return rounded(metrics.averages(_per_class(spark, folder)), "accuracy", "f1_macro",
                   "f1_weighted")


@query("m7_specificity", f"""WITH {CONFUSION_SQL}
SELECT class, round(specificity, 6) AS specificity FROM per_class""")
def specificity(spark, folder):
    return rounded(_per_class(spark, folder).select("class", "specificity"), "specificity")


@query("m12_clinical_flags", f"""WITH {CONFUSION_SQL}
SELECT class, round(recall, 6) AS recall, round(specificity, 6) AS specificity,
  CASE WHEN recall < 0.9 THEN 'risk of missed diagnoses' END AS recall_flag,
  CASE WHEN specificity < 0.9 THEN 'elevated false positive rate' END AS specificity_flag,
  bool_and(recall >= 0.9) OVER () AS all_recall_good FROM per_class""")
def clinical_flags(spark, folder):
    return rounded(metrics.clinical_flags(_per_class(spark, folder)), "recall", "specificity")


@query("m13_report", f"""WITH {CONFUSION_SQL},
rep AS (
  SELECT class::VARCHAR AS row, precision, recall, f1, support FROM per_class
  WHERE support > 0 OR predicted > 0
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support)
  FROM per_class
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)
  FROM per_class WHERE support > 0 OR predicted > 0
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
  FROM per_class)
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support::BIGINT AS support FROM rep""")
def report(spark, folder):
    return rounded(metrics.report(_per_class(spark, folder)), "precision", "recall", "f1")


CURVE_SQL = predictions_sql() + """,
cell AS (SELECT label, unnest(range(10)) AS class, unnest(probs) AS score FROM pred),
counts AS (SELECT class, score, count(*) FILTER (label = class) AS pos,
  count(*) FILTER (label <> class) AS neg FROM cell GROUP BY class, score),
curve AS (
  SELECT class, score, pos, neg,
    sum(pos) OVER (PARTITION BY class ORDER BY score DESC)::DOUBLE AS tp,
    sum(neg) OVER (PARTITION BY class ORDER BY score DESC)::DOUBLE AS fp,
    sum(pos) OVER (PARTITION BY class)::DOUBLE AS p,
    sum(neg) OVER (PARTITION BY class)::DOUBLE AS q,
    lag(pos) OVER (PARTITION BY class ORDER BY score DESC) AS before,
    lead(pos) OVER (PARTITION BY class ORDER BY score DESC) AS next_pos,
    lead(neg) OVER (PARTITION BY class ORDER BY score DESC) AS next_neg
  FROM counts),
roc AS (
  SELECT class::INT AS class, score AS threshold, fp / q AS fpr, tp / p AS tpr FROM curve
  WHERE p > 0 AND q > 0
    AND (before IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg)
  UNION ALL SELECT DISTINCT class::INT, NULL::DOUBLE, 0, 0 FROM curve WHERE p > 0 AND q > 0),
auc AS (SELECT class::INT AS class, CASE WHEN max(p) > 0 AND max(q) > 0
  THEN sum(pos * (q - fp + neg / 2.0::DOUBLE)) / (max(p) * max(q)) END AS auc
  FROM curve GROUP BY class)"""


def _points(spark, folder):
    return metrics.curve_points(metrics.score_counts(predictions(spark, folder), TOPICS))


@query("m8_auc", f"WITH {CURVE_SQL} SELECT class, round(auc, 6) AS auc FROM auc")
def auc(spark, folder):
    return rounded(metrics.auc_per_class(_points(spark, folder)), "auc")


@query("m9_macro_auc", f"""WITH {CURVE_SQL}
SELECT CASE WHEN count(auc) = 10 THEN round(avg(auc), 6) END AS auc_macro FROM auc""")
def macro_auc(spark, folder):
    return rounded(metrics.macro_auc(metrics.auc_per_class(_points(spark, folder)),
                                     len(TOPICS)), "auc_macro")


@query("m10_roc", f"""WITH {CURVE_SQL}
SELECT class, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""")
def roc(spark, folder):
    points = metrics.roc_points(_points(spark, folder))
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return rounded(points.withColumn("threshold", finite), "fpr", "tpr")


@query("m11_operating_point", f"""WITH {CURVE_SQL}
SELECT class, round(max(tpr), 6) AS tpr FROM roc WHERE fpr <= 0.05 GROUP BY class""")
def operating_point(spark, folder):
    points = metrics.roc_points(_points(spark, folder))
    return rounded(metrics.operating_point(points), "tpr")


@query("m14_worst_errors", f"""WITH {predictions_sql()}
SELECT id, p.label, pred, confidence, embedding[1]::DOUBLE AS x0
FROM pred p JOIN embeddings e ON e.vec_id = p.id
WHERE p.label <> pred ORDER BY confidence DESC, id LIMIT 20""")
def worst_errors(spark, folder):
    worst = metrics.worst_errors(predictions(spark, folder).drop("probs", "logits"), 20)
    catalog = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x0"))
    return catalog.join(F.broadcast(worst), "id")


def _all_models(spark, folder):
    frames = [predictions(spark, folder, a, b).withColumn("model", F.lit(name))
              for name, (a, b) in MODELS.items()]
    return reduce(lambda x, y: x.unionByName(y), frames).select("model", "id", "label", "pred",
                                                                "probs")


COMPARISON_SQL = ", ".join(predictions_sql(a, b, f"p_{name}")
                           for name, (a, b) in MODELS.items()) + """,
every AS (SELECT 'all' AS model, * FROM p_all UNION ALL SELECT 'back', * FROM p_back
  UNION ALL SELECT 'front', * FROM p_front),
class_counts AS (
  SELECT m.model, k.c AS class,
    count(*) FILTER (e.label = k.c) AS support, count(*) FILTER (e.pred = k.c) AS predicted,
    count(*) FILTER (e.label = k.c AND e.pred = k.c) AS tp
  FROM (SELECT DISTINCT model FROM every) m CROSS JOIN range(10) k(c)
  JOIN every e ON e.model = m.model GROUP BY 1, 2),
class_f1 AS (SELECT *, CASE WHEN support + predicted > 0
  THEN 2 * tp::DOUBLE / (support + predicted) ELSE 0 END AS f1 FROM class_counts),
cells AS (SELECT model, label, unnest(range(10)) AS class, unnest(probs) AS score FROM every),
ranks AS (SELECT model, class, label = class AS own, rank() OVER w + (count(*) OVER (
    PARTITION BY model, class, score) - 1) / 2.0::DOUBLE AS r FROM cells
  WINDOW w AS (PARTITION BY model, class ORDER BY score)),
aucs AS (SELECT model, class, (sum(r) FILTER (own)
    - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (own)::DOUBLE * count(*) FILTER (NOT own)) AS auc
  FROM ranks GROUP BY model, class)"""


@query("m16_model_comparison", f"""WITH {COMPARISON_SQL}
SELECT model, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
  round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS f1_macro,
  (SELECT round(avg(auc), 6) FROM aucs a WHERE a.model = f.model) AS auc_macro,
  {", ".join(f"round(max(f1) FILTER (class = {i}), 6) AS f1_{i}" for i in TOPICS)}
FROM class_f1 f GROUP BY model""")
def model_comparison(spark, folder):
    return _comparison(spark, folder)


@query("s9_comparison_file", ORACLE["m16_model_comparison"])
def comparison_file(spark, folder):
    """The comparison written as JSON and read back."""
    compared, path = _comparison(spark, folder), scratch_path(spark, "comparison")
    tables.write_metrics(compared, path)
    return spark.read.schema(compared.schema).json(path)


def _comparison(spark, folder):
    compared = metrics.model_comparison(_all_models(spark, folder), TOPICS)
    return rounded(compared, "accuracy", "f1_macro", "auc_macro", *[f"f1_{i}" for i in TOPICS])


@query("m17_log_loss", f"""WITH {predictions_sql()},
weight AS (SELECT label, (SELECT count(*) FROM pred) / (10.0::DOUBLE * count(*)) AS w
  FROM pred GROUP BY label)
SELECT round(avg(loss), 5) AS log_loss, round(sum(w * loss) / sum(w), 5) AS weighted_log_loss
FROM (SELECT label, ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
    + list_max(logits) - logits[label + 1] AS loss FROM pred) JOIN weight USING (label)""")
def log_loss(spark, folder):
    scored = predictions(spark, folder)
    weights = prep.class_weights(scored, TOPICS).select("label", "weight")
    weighted = metrics.log_loss(scored, weights).select(
        F.lit("w").alias("kind"), "log_loss")
    both = metrics.log_loss(scored).select(F.lit("p").alias("kind"), "log_loss").unionByName(
        weighted)
    return rounded(both.agg(
        F.max(F.when(F.col("kind") == "p", F.col("log_loss"))).alias("log_loss"),
        F.max(F.when(F.col("kind") == "w", F.col("log_loss"))).alias("weighted_log_loss")),
        "log_loss", "weighted_log_loss", digits=5)


@query("m18_metric_document", f"""WITH {CURVE_SQL}, {CONFUSION_SQL[len(predictions_sql()) + 2:]}
SELECT round((SELECT sum(tp)::DOUBLE / sum(support) FROM per_class), 6) AS accuracy,
  round((SELECT avg(f1) FROM per_class WHERE support > 0 OR predicted > 0), 6) AS f1_macro,
  round((SELECT avg(auc) FROM auc), 6) AS roc_auc_macro, class::VARCHAR AS class,
  round(precision, 6) AS precision, round(recall, 6) AS sensitivity,
  round(specificity, 6) AS specificity, round(f1, 6) AS f1, support,
  round(coalesce(auc, 0), 6) AS roc_auc
FROM per_class JOIN auc USING (class)""")
def metric_document(spark, folder):
    document = metrics.metric_document(
        _per_class(spark, folder), metrics.auc_per_class(_points(spark, folder)))
    flat = document.select("accuracy", "f1_macro", "roc_auc_macro",
                           F.explode("per_class").alias("class", "m"))
    return rounded(flat.select(
        "accuracy", "f1_macro", "roc_auc_macro", "class", "m.precision", "m.sensitivity",
        "m.specificity", "m.f1", "m.support", "m.roc_auc"),
        "accuracy", "f1_macro", "roc_auc_macro", "precision", "sensitivity", "specificity",
        "f1", "roc_auc")


@query("t1_best_epoch", f"""WITH {HISTORY_SQL}
SELECT run, arg_max(epoch, (val_f1_macro, -epoch)) AS epoch,
  max(val_f1_macro) AS val_f1_macro, arg_max(val_acc, (val_f1_macro, -epoch)) AS val_acc,
  arg_max(epoch_time, (val_f1_macro, -epoch)) AS epoch_time FROM history GROUP BY run""")
def best_epoch(spark, folder):
    return trainlog.best_epoch(history(spark, folder))


@query("t2_early_stop", f"""WITH RECURSIVE {HISTORY_SQL},
walk AS (
  SELECT run, epoch, val_f1_macro AS best, 0 AS waited FROM history WHERE epoch = 1
  UNION ALL
  SELECT h.run, h.epoch,
    CASE WHEN h.val_f1_macro > w.best + 0.001::DOUBLE THEN h.val_f1_macro ELSE w.best END,
    CASE WHEN h.val_f1_macro > w.best + 0.001::DOUBLE THEN 0 ELSE w.waited + 1 END
  FROM walk w JOIN history h ON h.run = w.run AND h.epoch = w.epoch + 1)
SELECT run, count(*) AS epochs, min(epoch) FILTER (waited >= 7) AS stopped
FROM walk GROUP BY run""")
def early_stop(spark, folder):
    return trainlog.early_stops(history(spark, folder))


BATCHES_SQL = """batches AS (
  SELECT event_type AS run, day(ts)::INT AS epoch, value AS loss,
    CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS rows,
    (CAST(json_extract(props, '$.k') AS BIGINT) + 1) // 2 AS hits, (event_id % 10) / 10.0::DOUBLE
      AS lam FROM events)"""


def _batches(spark, folder):
    rows = F.get_json_object("props", "$.k").cast("bigint") + 1
    return table(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.col("value").alias("loss"), rows.alias("rows"), F.expr(
            "(cast(get_json_object(props, '$.k') as bigint) + 1) div 2").alias("hits"),
        ((F.col("event_id") % 10) / F.lit(10.0)).alias("lam"))


@query("t3_epoch_metrics", f"""WITH {BATCHES_SQL}
SELECT run, epoch, round(sum(loss * rows) / sum(rows), 6) AS loss,
  round(sum(hits)::DOUBLE / sum(rows), 6) AS acc FROM batches GROUP BY run, epoch""")
def epoch_metrics(spark, folder):
    return rounded(trainlog.epoch_metrics(_batches(spark, folder)), "loss", "acc")


@query("t5_mixup_accuracy", f"""WITH {BATCHES_SQL}
SELECT run, epoch, round(sum(lam * hits + (1 - lam) * (rows - hits)) / sum(rows), 6) AS acc
FROM batches GROUP BY run, epoch""")
def mixup_accuracy(spark, folder):
    hits = _batches(spark, folder).withColumns(
        {"hits_a": F.col("hits"), "hits_b": F.col("rows") - F.col("hits")})
    return rounded(trainlog.mixup_accuracy(hits), "acc")


@query("t4_runs", f"""WITH {HISTORY_SQL}
SELECT run, max(val_f1_macro) AS best_f1, max(val_acc) AS best_acc, count(*) AS epochs,
  sum(epoch_time) AS total_time FROM history GROUP BY run""")
def runs(spark, folder):
    return trainlog.run_comparison(history(spark, folder))


@query("s10_training_history", f"""WITH {HISTORY_SQL}
SELECT run, epoch, val_f1_macro, val_acc, epoch_time FROM history""")
def training_history(spark, folder):
    """History files written per run and read back, one row per epoch."""
    rows, path = history(spark, folder), scratch_path(spark, "history")
    unused = {c: F.lit(0.0) for c in tables.HISTORY_COLUMNS if c not in rows.columns}
    tables.write_history(rows.withColumns(unused), path)
    return tables.read_history(spark, path).select("run", "epoch", "val_f1_macro", "val_acc",
                                                   "epoch_time")

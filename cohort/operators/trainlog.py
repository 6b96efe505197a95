"""Training-log tables: best epoch, early-stop replay, epoch metrics, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PATIENCE = 7
MIN_DELTA = 0.001


def best_epoch(history: DataFrame, score: str = "val_f1_macro") -> DataFrame:
    """The epoch a run's checkpoint comes from: the first with the highest score."""
    row = F.struct(*[F.col(c) for c in history.columns if c != "run"])
    order = F.struct(F.col(score).alias("score"), (-F.col("epoch")).alias("epoch"))
    best = history.groupBy("run").agg(F.max_by(row, order).alias("best"))
    return best.select("run", "best.*")


def stop_epoch(entries: Column, patience: int = PATIENCE, min_delta: float = MIN_DELTA,
               mode: str = "max") -> Column:
    """Epoch at which training stops, NULL if it runs to the end.

    ``entries`` are (epoch, score) in order.  A score counts only if it beats the best one by
    more than ``min_delta``, and the best one moves only then, so a running maximum is no
    substitute; the state is folded along the run.
    """
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode!r}")

    def step(state, entry):
        score = entry["score"]
        better = (score > state["best"] + min_delta if mode == "max"
                  else score < state["best"] - min_delta)
        better = state["best"].isNull() | better
        waited = F.when(better, 0).otherwise(state["waited"] + 1)
        return F.struct(
            F.when(better, score).otherwise(state["best"]).alias("best"),
            waited.alias("waited"),
            F.coalesce(state["stopped"], F.when(waited >= patience, entry["epoch"]))
            .alias("stopped"))

    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"),
                     F.lit(None).cast("int").alias("stopped"))
    return F.aggregate(entries, start, step, lambda state: state["stopped"])


def early_stops(history: DataFrame, score: str = "val_f1_macro", patience: int = PATIENCE,
                min_delta: float = MIN_DELTA, mode: str = "max") -> DataFrame:
    """Epochs run and the epoch at which early stopping would end each run.

    A run's own epochs are folded in order; that list is as long as the run has epochs.
    """
    entry = F.struct(F.col("epoch").cast("int").alias("epoch"),
                     F.col(score).cast("double").alias("score"))
    runs = history.groupBy("run").agg(F.count("*").alias("epochs"),
                                      F.array_sort(F.collect_list(entry)).alias("entries"))
    return runs.select("run", "epochs",
                       stop_epoch(F.col("entries"), patience, min_delta, mode).alias("stopped"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """Row-weighted loss and accuracy per run and epoch from per-batch rows (loss, hits, rows)."""
    return batches.groupBy("run", "epoch").agg(
        (F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("loss"),
        (F.sum("hits") / F.sum("rows")).alias("acc"))


def mixup_accuracy(batches: DataFrame) -> DataFrame:
    """Accuracy under mixing: hits on either label, weighted by lambda."""
    hits = F.col("lam") * F.col("hits_a") + (1 - F.col("lam")) * F.col("hits_b")
    return batches.groupBy("run", "epoch").agg((F.sum(hits) / F.sum("rows")).alias("acc"))


def run_comparison(history: DataFrame) -> DataFrame:
    """Best score, best accuracy, epochs and time per run."""
    return history.groupBy("run").agg(
        F.max("val_f1_macro").alias("best_f1"), F.max("val_acc").alias("best_acc"),
        F.count("*").alias("epochs"), F.sum("epoch_time").alias("total_time"))

"""Naive Bayes support vectors: a linear hinge-loss model over n-gram indicators.

Indicators are hashed n-grams of bytes and words of the whole text.  Each is scaled by the log ratio of its
smoothed shares in the two classes, and a linear model on the scaled indicators is fitted by dual
coordinate descent.  A logistic curve fitted to the margins turns them into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohort.llm.textbytes import BYTE_CODE, chunks, mix, run_hashes, word_bounds, word_hashes

#: Hashed indicators, n-gram lengths in bytes and in words, and labelled rows of each class that are fitted.
BITS, LENGTHS, WORDS, PER_CLASS = 18, (1, 2, 3), (1, 2), 1500
#: Kinds of bytes: n-grams are taken over these, so that they tell style rather than words.
_codes = np.arange(256)
_kind = np.where((_codes >= 97) & (_codes <= 122), ord("a"), _codes)
_kind = np.where((_codes >= 65) & (_codes <= 90), ord("A"), _kind)
_kind = np.where((_codes >= 48) & (_codes <= 57), ord("0"), _kind)
KIND = np.where(_codes >= 128, ord("a"), _kind).astype(np.uint8)


class Model(NamedTuple):
    """Weight of each indicator with its log-count ratio multiplied in, and the score curve."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The indicators of each text: hashed n-grams of bytes, of kinds of bytes, and of words."""
    def slots(total: np.ndarray, n: int) -> np.ndarray:
        return (mix(total + np.full(1, n, np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)

    grams = []
    for salt, codes in ((1, BYTE_CODE[data]), (2, mix(KIND[data].astype(np.uint64) + np.uint64(9)))):
        total = np.zeros(len(data), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if n > 1:
                total = mix(total[:-1]) + codes[n - 1:]
            else:
                total = codes + np.full(1, salt, np.uint64)
            if n in LENGTHS:
                grams.append((n, slots(total, n)))
    start, end, rows = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    runs = []
    for n in WORDS:  # a text of fewer words has one run of all of them
        hashed, first = run_hashes(words, rows, n)
        runs.append((slots(mix(hashed) + np.uint64(3), n),
                     np.searchsorted(rows[first], np.arange(len(offsets)))))
    out, seen = [], np.zeros(1 << bits, bool)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        seen[:] = False
        for n, hashed in grams:
            seen[hashed[a:max(b - n + 1, a)]] = True
        for hashed, of_row in runs:
            seen[hashed[of_row[k]:of_row[k + 1]]] = True
        out.append(np.flatnonzero(seen).astype(np.int32))
    return out


def log_ratios(texts: list[np.ndarray], labels: np.ndarray, bits: int = BITS,
               smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares of each indicator in classes 1 and 0."""
    counts = np.full((2, 1 << bits), smoothing)
    for features, label in zip(texts, labels):
        counts[label][features] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(texts: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray,
                 cost: float = 0.1, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear model on scaled indicators.

    One dual variable per text, 0 to ``cost``; each step solves for one of them exactly.  Classes
    of unequal size get costs that weigh them alike.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    limit = cost * 0.5 / np.maximum(share[labels], 1e-9)
    rows = [ratios[f] / max(np.sqrt((ratios[f] ** 2).sum()), 1e-12) for f in texts]
    weights, bias = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(texts))
    square = np.array([(r * r).sum() + 1.0 for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(texts)):
            f, r = texts[i], rows[i]
            slope = sign[i] * (weights[f] @ r + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[f] += step * r
                bias += step
                alpha[i] = new
    return weights, bias


def margin(model: Model, ratios: np.ndarray, features: np.ndarray) -> float:
    r = ratios[features]
    return float((model.weights[features] @ r) / max(np.sqrt(r @ r), 1e-12) + model.bias)


def score_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the margins, by Newton steps."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        g = weight * (p - goal)
        h = weight * p * (1 - p)
        grad = np.array([(g * margins).sum() + 1e-4 * slope, g.sum()])
        hess = np.array([[(h * margins ** 2).sum() + 1e-4, (h * margins).sum()],
                         [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
    return float(slope), float(shift)


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS) -> tuple[Model, np.ndarray]:
    """Model and log-count ratios from labelled texts."""
    found = [f for _, data, offsets in chunks(texts) for f in indicators(data, offsets, bits)]
    ratios = log_ratios(found, labels, bits)
    weights, bias = dual_descent(found, labels, ratios)
    model = Model(weights, bias, 1.0, 0.0)
    margins = np.array([margin(model, ratios, f) for f in found])
    return Model(weights, bias, *score_curve(margins, labels)), ratios


def _score(model: Model, ratios: np.ndarray, bits: int):
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            texts = pa.array(column, pa.string(), from_pandas=True)
            margins = [margin(model, ratios, f) for _, data, offsets in chunks(texts)
                       for f in indicators(data, offsets, bits)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(
                model.slope * np.array(margins) + model.shift, -30, 30))), dtype="float64")

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id",
                   text: str = "text", label: str = "quality", per_class: int = PER_CLASS,
                   bits: int = BITS) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    The model is fitted on rows that are not held out and whose key has a label, at most
    ``per_class`` rows of each class, those with the lowest hash of the key.  A key with several
    labels takes the smallest; null labels and null keys are not used.  Null and empty texts have
    no indicators and get the score of the bias.  Without rows of both classes every score is the
    share of class 1 among the labels found, 0.5 without any.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(
        F.min(label).cast("int").alias("label"))
    flag = F.coalesce(held_out, F.lit(False)).alias("held_out")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), flag)
    # at most 2 * per_class keys, whatever the tables: small enough to broadcast
    chosen = (known.join(source.where(~F.col("held_out")).select("key").distinct(), "key")
              .withColumn("h", F.xxhash64("key")))
    parts = [chosen.where(F.col("label") == c).orderBy("h", "key").limit(per_class)
             for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("key", "label")
    rows = (source.where(~F.col("held_out")).join(F.broadcast(chosen), "key")
            .groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"))
            .orderBy("key").toPandas())
    goal = rows["label"].to_numpy(int) if len(rows) else np.zeros(0, int)
    if len(set(goal.tolist())) == 2:
        model, ratios = fit(pa.array(rows["text"], pa.string(), from_pandas=True), goal, bits)
        score = F.pandas_udf(_score(model, ratios, bits), "double")("text")
    else:
        score = F.lit(float(goal.mean()) if len(goal) else 0.5)
    return source.select(F.col("key").alias(key), "held_out", score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))

"""Language of each word, and so of a text, by a linear-chain conditional random field.

Words are the places of the chain, languages its states.  A word's emission scores come from its
affixes, its byte n-grams and the lexicons it stands in; neighbouring words are tied by learned
transition scores, so a foreign passage inside a text is labelled as a run.  Labels of training
words are those of their texts.  Posteriors come from forward-backward over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.llm.textbytes import BYTE_CODE, LOWER, chunks, mix, word_bounds, word_hashes

#: Hashed features, and labelled rows of each language that are fitted.
BITS, PER_LANGUAGE = 16, 120
#: A word is in a language's lexicon if so many training texts of it, and a tenth of that share of
#: texts in any other at most, have it.
LEXICON_TEXTS = 3
#: Words of a chain that are multiplied up as one segment.
SEGMENT = 64
AFFIXES = (1, 2, 3)

LETTER = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (
    (np.arange(256) >= 65) & (np.arange(256) <= 90)) | (np.arange(256) >= 128)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray      # (features + languages, languages)
    transitions: np.ndarray  # (languages, languages), logs
    lexicon: np.ndarray      # sorted word hashes
    lexicon_of: np.ndarray   # language of each


def _wordy(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that have a letter."""
    start, end, rows = word_bounds(data, offsets)
    if not len(start):
        return start, end, rows
    letters = np.r_[0, np.cumsum(LETTER[data])]
    kept = letters[end] > letters[start]
    return start[kept], end[kept], rows[kept]


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray,
             lexicon: np.ndarray, lexicon_of: np.ndarray, bits: int = BITS
             ) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs."""
    n, drop = len(start), np.uint64(64 - bits)
    number, length = np.arange(n), end - start
    words, found = [], []

    def add(word: np.ndarray, code: np.ndarray, salt: int) -> None:
        words.append(word)
        found.append((mix(code + np.full(1, salt, np.uint64)) >> drop).astype(np.int64))

    for k in AFFIXES:
        fits = length >= k
        front = np.zeros(int(fits.sum()), np.uint64)
        back = front.copy()
        for j in range(k):
            front = mix(front) + BYTE_CODE[data[start[fits] + j]]
            back = mix(back) + BYTE_CODE[data[end[fits] - 1 - j]]
        add(number[fits], front, 10 + k)
        add(number[fits], back, 20 + k)
    for k in (2, 3):
        count = np.maximum(length - k + 1, 0)
        word = np.repeat(number, count)
        place = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        code = np.zeros(len(word), np.uint64)
        for j in range(k):
            code = mix(code) + BYTE_CODE[data[place + j]]
        add(word, code, 30 + k)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        hit = lexicon[at] == hashes
        words.append(number[hit])
        found.append((1 << bits) + lexicon_of[at[hit]])
    return np.concatenate(words), np.concatenate(found)


def emissions(word: np.ndarray, feature: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, weights[:, k][feature], n)
                     for k in range(weights.shape[1])], axis=1)


def posteriors(scores: np.ndarray, rows: np.ndarray, transitions: np.ndarray,
               segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Posterior and forward message of each place; ``rows`` ascends and separates the chains.

    Chains are cut into segments.  The matrix product of each segment is found for all segments
    at once, then messages pass from segment to segment, then within all segments at once: the
    same result as a walk over each chain, in far fewer steps.
    """
    n, states = scores.shape
    if not n:
        return scores, scores
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    step = np.exp(transitions - transitions.max())
    head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[head, n])
    parts = -(-counts // segment)
    chain = np.repeat(np.arange(len(head)), parts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = head[chain] + nth * segment
    size = np.minimum(segment, counts[chain] - nth * segment)
    first = nth == 0
    psi = np.ones((segment, len(chain), states))
    for t in range(min(segment, int(size.max()))):
        on = size > t
        psi[t, on] = local[begin[on] + t]
    product = np.broadcast_to(np.eye(states), (len(chain), states, states)).copy()
    for t in range(int(size.max())):
        on = size > t
        moved = (product[on].reshape(-1, states) @ step).reshape(-1, states, states)
        if t == 0:
            moved[first[on]] = product[on][first[on]]
        moved *= psi[t, on][:, None, :]
        product[on] = moved / moved.sum(axis=(1, 2), keepdims=True)
    before = np.full((len(chain), states), 1.0 / states)
    after = np.ones((len(chain), states))
    starts = np.flatnonzero(first)
    for j in range(1, int(parts.max())):
        here = starts[parts > j] + j
        message = (before[here - 1][:, None, :] @ product[here - 1])[:, 0]
        before[here] = message / message.sum(axis=1, keepdims=True)
    for j in range(int(parts.max()) - 2, -1, -1):
        here = starts[parts > j + 1] + j
        message = (product[here + 1] @ after[here + 1][:, :, None])[:, :, 0]
        after[here] = message / message.sum(axis=1, keepdims=True)
    out = np.empty((n, states))
    message = before
    for t in range(int(size.max())):
        on = size > t
        moved = message[on] @ step
        if t == 0:
            moved[first[on]] = message[on][first[on]]
        moved *= psi[t, on]
        moved /= moved.sum(axis=1, keepdims=True)
        message = message.copy()
        message[on] = moved
        out[begin[on] + t] = moved
    forward = out.copy()
    message = after
    for t in range(int(size.max()) - 1, -1, -1):
        on = size > t
        out[begin[on] + t] *= message[on]
        if t:
            moved = (psi[t, on] * message[on]) @ step.T
            message = message.copy()
            message[on] = moved / moved.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True), forward


def _pair_counts(post: np.ndarray, forward: np.ndarray, rows: np.ndarray,
                 transitions: np.ndarray) -> np.ndarray:
    """Expected number of each transition."""
    same = np.flatnonzero(rows[1:] == rows[:-1])
    step = np.exp(transitions - transitions.max())
    # what a place passes back: its posterior without what it got from the left
    into = forward[same] @ step
    back = post[same + 1] / np.maximum(into, 1e-300)
    norm = (into * back).sum(axis=1, keepdims=True)
    return ((forward[same] / norm).T @ back) * step


def fit(texts: pa.Array, labels: list[str], bits: int = BITS, rounds: int = 25,
        rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Fit by full-gradient AdaGrad on the log likelihood of the word labels."""
    languages = sorted(set(labels))
    code = np.array([languages.index(x) for x in labels])
    data, offsets = zip(*((d, o) for _, d, o in chunks(texts, 1 << 50)))
    data, offsets = data[0], offsets[0]
    start, end, rows = _wordy(data, offsets)
    hashes = word_hashes(data, start, end)
    goal = code[rows]
    unique, sample, index = np.unique(hashes, return_index=True, return_inverse=True)
    # lexicon: in how many texts of each language each word stands
    held = np.unique(np.stack([index, rows]), axis=1)
    n_texts = np.bincount(code, minlength=len(languages))
    count = np.stack([np.bincount(held[0][code[held[1]] == k], minlength=len(unique))
                      for k in range(len(languages))], axis=1)
    share = count / np.maximum(n_texts, 1)
    best = share.argmax(axis=1)
    top = share.max(axis=1)
    others = np.where(np.arange(len(languages)) == best[:, None], 0, share).max(axis=1)
    chosen = (count[np.arange(len(unique)), best] >= LEXICON_TEXTS) & (others <= 0.1 * top)
    lexicon, lexicon_of = unique[chosen], best[chosen]
    word, feature = features(data, start[sample], end[sample], unique, lexicon, lexicon_of, bits)
    k = len(languages)
    weights = np.zeros(((1 << bits) + k, k))
    transitions = np.zeros((k, k))
    seen, seen_t = np.full(weights.shape, 1e-8), np.full((k, k), 1e-8)
    certain = np.eye(k)[goal]
    pairs = np.zeros((k, k))
    same = np.flatnonzero(rows[1:] == rows[:-1])
    np.add.at(pairs, (goal[same], goal[same + 1]), 1)
    for _ in range(rounds):
        scores = emissions(word, feature, weights, len(unique))[index]
        post, forward = posteriors(scores, rows, transitions)
        wrong = post - certain
        by_word = np.stack([np.bincount(index, wrong[:, j], len(unique)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(feature, by_word[:, j][word], len(weights))
                         for j in range(k)], axis=1) / len(rows) + decay * weights
        seen += grad ** 2
        weights -= rate * grad / np.sqrt(seen)
        grad = (_pair_counts(post, forward, rows, transitions) - pairs) / len(rows) \
            + 1e-3 * transitions
        seen_t += grad ** 2
        transitions -= 0.2 * rate * grad / np.sqrt(seen_t)
    return Model(languages, weights, transitions, lexicon, lexicon_of)


def label_texts(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """(language, share of the words that it labels) per text; no letters: und, 0."""
    names, shares = ["und"] * len(texts), [0.0] * len(texts)
    for first, data, offsets in chunks(texts):
        start, end, rows = _wordy(data, offsets)
        if not len(start):
            continue
        hashes = word_hashes(data, start, end)
        word, feature = features(data, start, end, hashes, model.lexicon, model.lexicon_of)
        scores = emissions(word, feature, model.weights, len(start))
        post, _ = posteriors(scores, rows, model.transitions)
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        mass = np.add.reduceat(post, head, axis=0)
        mass /= mass.sum(axis=1, keepdims=True)
        ascii_only = LETTER & (np.arange(256) < 128)
        plain = np.r_[0, np.cumsum(ascii_only[data])]
        for row, share in zip(rows[head].tolist(), mass):
            # bytes beyond ASCII may be signs, not letters
            if plain[offsets[row + 1]] > plain[offsets[row]] or any(
                    c.isalpha() for c in texts[first + row].as_py()):
                names[first + row] = model.languages[int(share.argmax())]
                shares[first + row] = float(share.max())
    return names, shares


def _label(model: Model):
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            names, shares = label_texts(model, pa.array(column, pa.string(), from_pandas=True))
            yield pd.DataFrame({"lang_pred": names, "score": shares})

    return run


def with_languages(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
                   lang: str = "lang", per_language: int = PER_LANGUAGE,
                   name: str = "predicted") -> DataFrame:
    """Add ``name``, a struct of lang_pred and score, to ``docs``; a column of that name goes.

    The model is fitted on rows that are not held out and have key, text and language: at most
    ``per_language`` distinct texts of each language, those with the lowest hash.  Null texts and
    texts without a letter are ``und`` with score 0, and so is all if nothing can be learned.
    A text that repeats counts once in training and is labelled each time.  Ties between
    languages go to the first by name.  The number of languages has to be small; the model and the
    training rows pass through the driver, nothing else does.
    """
    known = docs.where(~held_out & F.col(key).isNotNull() & F.col(lang).isNotNull()
                       & (F.length(text) > 0)).select(
        F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    # hashes are picked before texts are moved: per_language of each language, small enough to
    # broadcast whatever the table
    lowest = Window.partitionBy("l").orderBy("h")
    picked = (known.select("l", "h").distinct().withColumn("nth", F.row_number().over(lowest))
              .where(F.col("nth") <= per_language).drop("nth"))
    rows = (known.join(F.broadcast(picked), ["l", "h"]).dropDuplicates(["l", "h"])
            .orderBy("l", "h").toPandas())
    out = "lang_pred string, score double"
    if not len(rows):
        return docs.withColumn(name, F.struct(F.lit("und").alias("lang_pred"),
                                                     F.lit(0.0).alias("score")))
    model = fit(pa.array(rows["t"], pa.string()), rows["l"].tolist())
    return docs.withColumn(name, F.pandas_udf(_label(model), out)(text))

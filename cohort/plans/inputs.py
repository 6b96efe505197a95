"""What the given tables stand for, and the same definitions in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohort.functions.vectors import arg_max, softmax
from cohort.operators.fingerprint import text_print
from cohort.session import spread, written

LANGUAGES = ("de", "en", "es", "fr")
TOPICS = tuple(range(10))
DIMENSIONS = 64
BITS = 64
DISTANCE = 3
SHARPNESS = 10.0
SALT = "linkage-salt"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows: id, text, label (language), original side from the number of the source."""
    docs = table(spark, folder, "documents")
    even = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "source", "n_chars",
        F.when(even, "Training").otherwise("Testing").alias("original"),
        F.when(even, "train").otherwise("test").alias("original_split"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows with the fingerprint of the whole text, written once."""
    docs = spread(documents(spark, folder))
    return written(docs.select("id", "label", "original", "original_split",
                               text_print(F.col("text")).alias("print")), "prints")


DOCS_SQL = r"""docs AS (
  SELECT doc_id AS id, text, lang AS label, source, n_chars,
    CASE WHEN CAST(regexp_extract(source, '(\d+)', 1) AS INT) % 2 = 0
      THEN 'Training' ELSE 'Testing' END AS original,
    CASE WHEN CAST(regexp_extract(source, '(\d+)', 1) AS INT) % 2 = 0
      THEN 'train' ELSE 'test' END AS original_split
  FROM documents)"""

PRINTS_SQL = DOCS_SQL + r""",
token AS (
  SELECT doc_id AS id, unnest(list_distinct(list_filter(
    regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> ''))) AS t
  FROM documents),
hashed AS (SELECT id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM token),
bit_counts AS (
  SELECT id, b, sum((h >> b) & 1)::BIGINT AS c FROM hashed, range(64) r(b) GROUP BY id, b),
vectors AS (SELECT id, list(c ORDER BY b DESC) AS v FROM bit_counts GROUP BY id),
middles AS (SELECT id, v, list_sort(v)[32] + list_sort(v)[33] AS m FROM vectors),
words AS (
  SELECT id, list_sum(list_transform(v, lambda x, i: CASE WHEN 2 * x > m
    THEN 1::UBIGINT << (64 - i)::INT ELSE 0::UBIGINT END))::UBIGINT AS w FROM middles),
prints AS (
  SELECT d.id, d.label, d.original, d.original_split, w,
    lpad(lower(to_hex(w)), 16, '0') AS print
  FROM docs d LEFT JOIN words USING (id))"""

GROUPS_SQL = PRINTS_SQL + """,
groups AS (
  SELECT label, print, w, count(*) AS n, min(id) AS first FROM prints
  WHERE print IS NOT NULL GROUP BY label, print, w),
near AS (
  SELECT a.label, a.print AS print1, b.print AS print2, a.first AS first1, b.first AS first2,
    a.n AS n1, b.n AS n2, bit_count(xor(a.w, b.w))::INT AS distance,
    (a.n * b.n)::BIGINT AS pairs
  FROM groups a JOIN groups b ON a.label = b.label AND a.print < b.print
  WHERE bit_count(xor(a.w, b.w)) <= 3
  UNION ALL
  SELECT label, print, print, first, first, n, n, 0, (n * (n - 1) // 2)::BIGINT
  FROM groups WHERE n > 1)"""

CLUSTERS_SQL = "RECURSIVE " + GROUPS_SQL + """,
edge AS (
  SELECT first1 AS u, first2 AS v FROM near WHERE distance > 0
  UNION SELECT first2, first1 FROM near WHERE distance > 0),
reach AS (
  SELECT first AS u, first AS v FROM groups
  UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
root AS (SELECT u AS first, min(v) AS cluster_id FROM reach GROUP BY u),
clustered AS (
  SELECT p.id, p.label, p.original, p.original_split, p.print,
    coalesce(root.cluster_id, p.id) AS cluster_id
  FROM prints p LEFT JOIN groups g USING (label, print) LEFT JOIN root USING (first))"""

ASSIGNED_SQL = CLUSTERS_SQL + """,
vote AS (
  SELECT cluster_id, label, count(*) AS votes, min(id) AS seen FROM clustered
  GROUP BY cluster_id, label),
cluster AS (
  SELECT cluster_id, arg_min(label, (-votes, seen)) AS cluster_label,
    sum(votes)::BIGINT AS size, count(*) > 1 AS mixed
  FROM vote GROUP BY cluster_id),
queued AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_label
      ORDER BY size DESC, md5('42|' || cluster_id), cluster_id) AS step,
    row_number() OVER (PARTITION BY cluster_label, size
      ORDER BY md5('42|' || cluster_id), cluster_id) AS place,
    sum(size) OVER (PARTITION BY cluster_label)::BIGINT AS everything
  FROM cluster),
greedy AS (
  SELECT cluster_label, 0::BIGINT AS step, 0::BIGINT AS size, '' AS pool, 0::BIGINT AS a,
    0::BIGINT AS b, 0::BIGINT AS c
  FROM (SELECT DISTINCT cluster_label FROM cluster)
  UNION ALL
  SELECT cluster_label, step, size, pool, a + CASE WHEN pool = 'train' THEN size ELSE 0 END,
    b + CASE WHEN pool = 'val' THEN size ELSE 0 END,
    c + CASE WHEN pool = 'test' THEN size ELSE 0 END
  FROM (
    SELECT q.cluster_label, q.step, q.size, g.a, g.b, g.c,
      CASE WHEN q.everything * 0.7::DOUBLE - g.a >= q.everything * 0.15::DOUBLE - g.b
            AND q.everything * 0.7::DOUBLE - g.a >= q.everything * 0.15::DOUBLE - g.c
           THEN 'train'
           WHEN q.everything * 0.15::DOUBLE - g.b >= q.everything * 0.15::DOUBLE - g.c
           THEN 'val' ELSE 'test' END AS pool
    FROM greedy g JOIN queued q ON q.cluster_label = g.cluster_label AND q.step = g.step + 1)),
quota AS (
  SELECT cluster_label, size, count(*) FILTER (pool = 'train') AS q_train,
    count(*) FILTER (pool = 'val') AS q_val
  FROM greedy WHERE step > 0 GROUP BY cluster_label, size),
assigned AS (
  SELECT c.*, CASE WHEN q.place <= o.q_train THEN 'train'
    WHEN q.place <= o.q_train + o.q_val THEN 'val' ELSE 'test' END AS split
  FROM clustered c JOIN queued q USING (cluster_id)
  JOIN quota o ON o.cluster_label = q.cluster_label AND o.size = q.size)"""


def centroids(vectors: DataFrame) -> list[list[float]]:
    """Mean vector of every topic; topics times dimensions numbers."""
    means = [F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}")
             for i in range(DIMENSIONS)]
    rows = {r["label"]: list(r)[1:] for r in vectors.groupBy("label").agg(*means).collect()}
    return [rows[topic] for topic in TOPICS]


def topic_logits(vector: Column, points: list[list[float]]) -> Column:
    """Sharpened cosine to every centroid: one small matrix product per Arrow batch."""
    matrix = np.array(points)
    matrix = SHARPNESS * (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        rows = np.stack(vectors.to_list()).astype(float)
        return pd.Series(list(rows @ matrix / np.linalg.norm(rows, axis=1, keepdims=True)))

    return logits(vector)


def predictions(spark: SparkSession, folder: str, first: int = 0,
                last: int = DIMENSIONS) -> DataFrame:
    """id, label, probs, pred, confidence: softmax of the cosine to the topic centroids.

    Only the dimensions from ``first`` to ``last`` are looked at, which makes several models.
    """
    vectors = table(spark, folder, "embeddings")
    points = [p[first:last] for p in centroids(vectors)]
    seen = F.slice("embedding", first + 1, last - first)
    scored = (vectors.select(F.col("vec_id").alias("id"), "label",
                             topic_logits(seen, points).alias("logits"))
              .select("id", "label", "logits",
                      F.transform(softmax(F.col("logits")), lambda x: F.round(x, 6))
                      .alias("probs")))
    return scored.withColumns({"pred": arg_max(F.col("probs")),
                               "confidence": F.array_max("probs")})


def predictions_sql(first: int = 0, last: int = DIMENSIONS, name: str = "pred") -> str:
    """The same predictions as a chain of common table expressions ending in ``name``."""
    return f"""{name}_mean AS (
  SELECT label, list(m ORDER BY i) AS c FROM (
    SELECT label, i, avg(embedding[i]::DOUBLE) AS m
    FROM embeddings, range({first + 1}, {last + 1}) r(i) GROUP BY label, i)
  GROUP BY label),
{name}_logit AS (
  SELECT e.vec_id AS id, e.label, list({SHARPNESS}::DOUBLE * list_cosine_similarity(
      e.embedding[{first + 1}:{last}]::DOUBLE[], m.c) ORDER BY m.label) AS logits
  FROM embeddings e, {name}_mean m GROUP BY e.vec_id, e.label),
{name}_raised AS (
  SELECT id, label, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS r
  FROM {name}_logit),
{name}_probs AS (
  SELECT id, label, logits, list_transform(r, lambda x: round(x / list_sum(r), 6)) AS probs
  FROM {name}_raised),
{name} AS (
  SELECT *, (list_position(probs, list_max(probs)) - 1)::INT AS pred,
    list_max(probs) AS confidence
  FROM {name}_probs)"""


CONFUSION_SQL = predictions_sql() + """,
cm AS (
  SELECT l.c::INT AS label, p.c::INT AS pred, count(x.id) AS n
  FROM range(10) l(c) CROSS JOIN range(10) p(c)
  LEFT JOIN pred x ON x.label = l.c AND x.pred = p.c GROUP BY 1, 2),
sums AS (
  SELECT k.c::INT AS class, (SELECT sum(n) FROM cm WHERE label = k.c)::BIGINT AS support,
    (SELECT sum(n) FROM cm WHERE pred = k.c)::BIGINT AS predicted,
    (SELECT sum(n) FROM cm WHERE label = k.c AND pred = k.c)::BIGINT AS tp,
    (SELECT sum(n) FROM cm)::BIGINT AS total
  FROM range(10) k(c)),
per_class AS (
  SELECT class, support, predicted, tp,
    CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0
      THEN 2 * tp::DOUBLE / (support + predicted) ELSE 0 END AS f1,
    CASE WHEN total > support THEN (total - support - predicted + tp)::DOUBLE
      / (total - support) ELSE 0 END AS specificity
  FROM sums)"""


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Training history: run = event type, epoch = day, figures from the day's values."""
    events = table(spark, folder, "events")
    return events.groupBy(F.col("event_type").alias("run"),
                          F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value") / 100, 10).alias("val_f1_macro"),
        F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("val_acc"),
        F.count("*").cast("double").alias("epoch_time"))


HISTORY_SQL = """history AS (
  SELECT event_type AS run, day(ts)::INT AS epoch, round(avg(value) / 100, 10) AS val_f1_macro,
    round(avg((value > 50)::INT), 6) AS val_acc, count(*)::DOUBLE AS epoch_time
  FROM events GROUP BY 1, 2)"""


def vector_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every 64-number vector as a grey 8 x 8 picture in the shape of the image source."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    low, high = F.array_min("v"), F.array_max("v")
    scaled = vectors.withColumns({"low": low, "span": high - low})
    octets = F.transform("v", lambda x: F.lpad(F.hex(F.floor(
        (x - F.col("low")) / F.col("span") * 255)), 2, "0"))
    image = F.struct(F.concat(F.lit("vec/"), "vec_id").alias("origin"), F.lit(8).alias("height"),
                     F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"),
                     F.unhex(F.array_join(octets, "")).alias("data"))
    return scaled.select("vec_id", "label", image.alias("image"))


PIXELS_SQL = """pixels AS (
  SELECT vec_id, label, list_transform(v, lambda x: floor(
    (x - list_min(v)) / (list_max(v) - list_min(v)) * 255)) AS p
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})

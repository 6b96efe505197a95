"""Weights, resampling, batches, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import prep
from cohort.plans.inputs import DOCS_SQL, LANGUAGES, documents, rounded, table
from cohort.plans.registry import query

WEIGHTED = (*LANGUAGES, "xx")
WEIGHTS_SQL = f"""WITH {DOCS_SQL},
counts AS (SELECT l.label, count(d.id) AS n
  FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')) l(label)
  LEFT JOIN docs d USING (label) GROUP BY l.label),
weights AS (SELECT label, n, (SELECT count(*) FROM docs)::DOUBLE / (5 * greatest(n, 1)) AS weight
  FROM counts)"""


@query("w1_class_weights", WEIGHTS_SQL + """
SELECT label, n, round(weight, 6) AS weight FROM weights""")
def class_weights(spark, folder):
    return rounded(prep.class_weights(documents(spark, folder), WEIGHTED), "weight")


@query("w2_sample_weights", WEIGHTS_SQL + """
SELECT id, label, round(weight, 6) AS weight FROM docs JOIN weights USING (label)""")
def sample_weights(spark, folder):
    docs = documents(spark, folder).select("id", "label")
    return rounded(prep.sample_weights(docs, WEIGHTED), "weight")


def uniform_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("w3_resample", f"""WITH {DOCS_SQL},
ranked AS (SELECT id, label, row_number() OVER (PARTITION BY label
    ORDER BY md5('42|rank|' || id), id) AS place, count(*) OVER (PARTITION BY label) AS n
  FROM docs),
sizes AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS slot
  FROM docs GROUP BY label),
draws AS (SELECT d.i AS draw, least(floor({uniform_sql("'42|class|' || d.i")} * 4), 3) AS slot
  FROM range((SELECT count(*) FROM docs)) d(i))
SELECT draw, label, id FROM draws JOIN sizes USING (slot) JOIN ranked USING (label)
WHERE place = floor({uniform_sql("'42|row|' || draw")} * sizes.n) + 1""")
def resample(spark, folder):
    docs = documents(spark, folder).select("id", "label")
    return prep.weighted_resample(docs, "id", LANGUAGES).select("draw", "label", "id")


@query("w3_poisson", f"""WITH {DOCS_SQL},
sizes AS (SELECT label, (SELECT count(*) FROM docs)::DOUBLE / (4 * count(*)) AS mean
  FROM docs GROUP BY label),
parts AS (SELECT label, mean, greatest(1, ceil(mean / 8))::BIGINT AS parts FROM sizes),
cuts AS (
  SELECT label, parts, k, sum(term) OVER (PARTITION BY label ORDER BY k) AS cut FROM (
    SELECT label, parts, k, exp(-mean / parts) * pow(mean / parts, k) / factorial(k::INT) AS term
    FROM parts, range(33) t(k))),
draws AS (
  SELECT id, label, i, {uniform_sql("'42|poisson|' || id || '|' || i")} AS u
  FROM docs JOIN parts USING (label), range(1, parts + 1) t(i)),
counts AS (SELECT id, label, count(*) AS n FROM draws d JOIN cuts c USING (label)
  WHERE c.cut <= d.u GROUP BY id, label)
SELECT id, label, unnest(range(1, n + 1))::INT AS copy FROM counts""")
def poisson_resample(spark, folder):
    docs = documents(spark, folder).select("id", "label")
    return prep.poisson_resample(docs, "id", LANGUAGES)


ORDER_SQL = """placed AS (
  SELECT vec_id, label, embedding, row_number() OVER (
    ORDER BY md5('42|' || 0 || '|' || vec_id), vec_id) - 1 AS zero,
    count(*) OVER () AS everything FROM embeddings)"""


@query("w4_shuffle", f"WITH {ORDER_SQL} SELECT vec_id, zero + 1 AS position FROM placed")
def shuffle(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id")
    return prep.shuffled(vectors, "vec_id").select("vec_id", "position")


@query("w5_batches", f"""WITH {ORDER_SQL}
SELECT vec_id, zero // 32 AS batch_id, (zero % 32)::INT AS slot FROM placed
WHERE zero // 32 < everything // 32""")
def batches(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id")
    return prep.batches(vectors, "vec_id", 32, drop_last=True)


@query("w6_mixup", f"""WITH {ORDER_SQL},
batched AS (SELECT *, zero // 32 AS batch_id, (zero % 32)::INT AS slot FROM placed),
sides AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY slot) AS a,
    row_number() OVER (PARTITION BY batch_id ORDER BY md5('42|partner|' || vec_id), vec_id) AS b
  FROM batched),
mixed AS (
  SELECT x.batch_id, x.slot, x.vec_id, y.vec_id AS partner, x.label AS label_a,
    y.label AS label_b, {uniform_sql("'42|lambda|' || x.batch_id")} AS lam,
    x.embedding AS e, y.embedding AS f
  FROM sides x JOIN sides y ON x.batch_id = y.batch_id AND x.a = y.b)
SELECT batch_id, slot, vec_id, partner, label_a, label_b, round(lam, 6) AS lam,
  round(lam * e[1]::DOUBLE + (1 - lam) * f[1]::DOUBLE, 6) AS x0,
  round(lam * e[64]::DOUBLE + (1 - lam) * f[64]::DOUBLE, 6) AS x63
FROM mixed""")
def mixup(spark, folder):
    batched = prep.batches(table(spark, folder, "embeddings"), "vec_id", 32)
    batched = batched.withColumn("embedding", F.col("embedding").cast("array<double>"))
    mixed = prep.mixup(batched, "vec_id", "embedding", alpha=1.0)
    return rounded(mixed.select(
        "batch_id", "slot", "vec_id", "partner", "label_a", "label_b", "lam",
        F.col("mixed")[0].alias("x0"), F.col("mixed")[63].alias("x63")), "lam", "x0", "x63")


@query("w6_mixup_beta")
def mixup_beta(spark, folder):
    """Mixing with Beta(0.2, 0.2); numpy draws lambda, so there is no SQL form."""
    batched = prep.batches(table(spark, folder, "embeddings"), "vec_id", 32)
    batched = batched.withColumn("embedding", F.col("embedding").cast("array<double>"))
    mixed = prep.mixup(batched, "vec_id", "embedding", alpha=0.2)
    return mixed.select("batch_id", "slot", "vec_id", "partner", "lam", "label_a", "label_b",
                        F.col("mixed")[0].alias("x0"))

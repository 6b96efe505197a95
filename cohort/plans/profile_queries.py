"""Catalog, validation and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.functions.names import base_name, parent_name, path_split, sanitized, suffix
from cohort.functions.vectors import denormalise, normalise
from cohort.operators import catalog, profile, validate
from cohort.operators.augment import MEAN, STD
from cohort.plans.inputs import DOCS_SQL, LANGUAGES, documents, rounded, table
from cohort.plans.registry import query

SIDES = ("test", "train")
KNOWN = {name: i for i, name in enumerate(("de", "en", "fr"))}


@query("a1_class_distribution", f"""WITH {DOCS_SQL}
SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
FROM docs GROUP BY label""")
def class_distribution(spark, folder):
    return rounded(catalog.class_distribution(documents(spark, folder)), "pct")


@query("a2_split_by_class", f"""WITH {DOCS_SQL},
keys AS (SELECT * FROM (VALUES ('test'), ('train'), (NULL)) s(split)
  CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr'), (NULL)) l(label)),
counts AS (SELECT original_split AS split, label, count(*) AS n FROM docs
  GROUP BY CUBE (original_split, label))
SELECT k.split, k.label, coalesce(c.n, 0) AS n,
  round(coalesce(c.n, 0) * 100.0::DOUBLE / (SELECT t.n FROM counts t
    WHERE t.split IS NOT DISTINCT FROM k.split AND t.label IS NULL), 6) AS pct
FROM keys k LEFT JOIN counts c
  ON c.split IS NOT DISTINCT FROM k.split AND c.label IS NOT DISTINCT FROM k.label""")
def split_by_class(spark, folder):
    return rounded(catalog.split_by_class(documents(spark, folder), SIDES, LANGUAGES,
                                          split="original_split"), "pct")


@query("a3_topk_sizes", """SELECT p_size, p_type, count(*) AS n FROM part
GROUP BY p_size, p_type ORDER BY n DESC, p_size, p_type LIMIT 10""")
def topk_sizes(spark, folder):
    return catalog.top_counts(table(spark, folder, "part"), ["p_size", "p_type"], 10)


@query("a3_distinct_sizes", """SELECT count(*) AS distinct_n
FROM (SELECT DISTINCT p_size, p_type FROM part)""")
def distinct_sizes(spark, folder):
    return catalog.distinct_combinations(table(spark, folder, "part"), ["p_size", "p_type"])


@query("a4_modes", """SELECT l_linestatus AS mode, count(*) AS n FROM lineitem
GROUP BY 1 ORDER BY n DESC, mode LIMIT 10""")
def modes(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("mode"))
    return catalog.top_counts(rows, ["mode"], 10)


MOMENTS_SQL = """moments AS (
  SELECT l_returnflag AS split, channel, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std
  FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount', 'l_tax']) AS channel,
    unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) GROUP BY 1, 2)"""


def _moments(spark, folder):
    sums = profile.column_sums(
        table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "split"),
        ["l_quantity", "l_discount", "l_tax"], ["split"])
    return profile.channel_moments(sums, ["split"])


@query("a5_channel_moments", f"""WITH {MOMENTS_SQL}
SELECT split, channel, n, round(mean, 6) AS mean, round(std, 6) AS std FROM moments""")
def channel_moments(spark, folder):
    return rounded(_moments(spark, folder), "mean", "std")


@query("a7_drift", f"""WITH {MOMENTS_SQL},
spreads AS (
  SELECT channel, 'mean' AS stat, max(mean) - min(mean) AS spread FROM moments GROUP BY channel
  UNION ALL
  SELECT channel, 'std', max(std) - min(std) FROM moments GROUP BY channel)
SELECT channel, stat, round(spread, 6) AS spread,
  CASE WHEN spread < 0.02 THEN 'OK' ELSE 'DRIFT' END AS status FROM spreads""")
def drift(spark, folder):
    return rounded(profile.drift(_moments(spark, folder)), "spread")


@query("a6_seeded_sample", f"""WITH {DOCS_SQL}
SELECT id, label FROM docs ORDER BY md5('42|' || id), id LIMIT 100""")
def seeded_sample(spark, folder):
    return catalog.seeded_sample(documents(spark, folder).select("id", "label"), "id", 100)


@query("m15_examples", f"""WITH {DOCS_SQL}
SELECT label, original_split, id, example FROM (
  SELECT label, original_split, id, row_number() OVER (
    PARTITION BY label, original_split ORDER BY id)::INT AS example FROM docs)
WHERE example <= 5""")
def examples(spark, folder):
    docs = documents(spark, folder).select("label", "original_split", "id")
    return catalog.first_examples(docs, 5, ["label", "original_split"], "id")


@query("j11_absent_classes", f"""WITH {DOCS_SQL},
keys AS (SELECT source AS split, l.label FROM (SELECT DISTINCT source FROM docs),
  (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) l(label))
SELECT split, label FROM keys
EXCEPT SELECT source, label FROM docs""")
def absent_classes(spark, folder):
    docs = documents(spark, folder).withColumnRenamed("source", "split")
    sources = [r[0] for r in docs.select("split").distinct().collect()]  # pools are few
    return catalog.absent_classes(docs, sources, (*LANGUAGES, "it"))


@query("p1_path_parts", r"""SELECT page_id, string_split(url, '/')[-2] AS label,
  CASE WHEN contains(url, 'blog') THEN 'train' ELSE 'test' END AS split,
  string_split(url, '/')[-1] AS name,
  regexp_extract(string_split(url, '/')[-1], '^.+?(\.[^.]+)$', 1) AS suffix
FROM pages""")
def path_parts(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", parent_name(url).alias("label"), path_split(url, "blog").alias("split"),
        base_name(url).alias("name"), suffix(url).alias("suffix"))


@query("p2_encode_labels", f"""WITH {DOCS_SQL}
SELECT label, CASE label WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END::BIGINT AS label_idx,
  count(*) AS n FROM docs WHERE label IN ('de', 'en', 'fr') GROUP BY label""")
def encode_labels(spark, folder):
    encoded = catalog.encode_labels(documents(spark, folder), KNOWN)
    return encoded.groupBy("label", "label_idx").agg(F.count("*").alias("n"))


@query("p2_unknown_classes", f"""WITH {DOCS_SQL}
SELECT label, count(*) AS rows FROM docs WHERE label NOT IN ('de', 'en', 'fr') GROUP BY label""")
def unknown_classes(spark, folder):
    return catalog.unknown_classes(documents(spark, folder), KNOWN)


UPLOADS_SQL = r"""uploads AS (
  SELECT doc_id AS id, source || '/Scan ' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.jpg'
      WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.dcm' ELSE '' END AS filename,
    CASE WHEN doc_id % 7 = 0 THEN 'application/pdf' WHEN doc_id % 7 = 1 THEN NULL
      ELSE 'image/png' END AS content_type,
    n_chars * 2048 AS size, regexp_matches(text, '[A-Z]') AS decodable FROM documents)"""


def uploads(docs, *more):
    number = F.col("doc_id") % 5
    ending = (F.when(number == 0, ".jpg").when(number == 1, ".PNG").when(number == 2, ".jpeg")
              .when(number == 3, ".dcm").otherwise(""))
    kind = (F.when(F.col("doc_id") % 7 == 0, "application/pdf")
            .when(F.col("doc_id") % 7 > 1, "image/png"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/Scan "), "doc_id", ending).alias("filename"),
        kind.alias("content_type"), (F.col("n_chars") * 2048).alias("size"),
        F.col("text").rlike("[A-Z]").alias("decodable"), *more)


REASONS_SQL = UPLOADS_SQL + """,
reasons AS (SELECT id, filename, CASE
  WHEN id % 5 > 2 THEN 'unsupported file type'
  WHEN id % 7 = 0 THEN 'invalid content type'
  WHEN size > 10 * 1024 * 1024 THEN 'file too large'
  WHEN NOT decodable THEN 'could not open image' END AS reason
FROM uploads)"""


@query("p3_validate_rejects", f"WITH {REASONS_SQL} SELECT id, filename, reason FROM reasons")
def validate_rejects(spark, folder):
    reason = validate.reject_reason(F.col("filename"), F.col("content_type"), F.col("size"),
                                    F.col("decodable"))
    rows = uploads(table(spark, folder, "documents"))
    return rows.select("id", "filename", reason.alias("reason"))


@query("p5_sanitize_names", rf"""WITH {UPLOADS_SQL}
SELECT id, CASE WHEN id % 11 = 0 THEN 'unknown' ELSE
  substr(sha256('Scan ' || id), 1, 12) || CASE id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG'
    WHEN 2 THEN '.jpeg' WHEN 3 THEN '.dcm' ELSE '' END END AS resource FROM uploads""")
def sanitize_names(spark, folder):
    name = F.when(F.col("id") % 11 != 0, F.col("filename"))
    rows = uploads(table(spark, folder, "documents"))
    return rows.select("id", sanitized(name).alias("resource"))


@query("p10_normalise", """SELECT vec_id,
  round((embedding[1]::DOUBLE - 0.485) / 0.229, 6) AS x0,
  round((embedding[5]::DOUBLE - 0.456) / 0.224, 6) AS x4,
  round((embedding[64]::DOUBLE - 0.485) / 0.229, 6) AS x63,
  round(least(1, greatest(0, embedding[5]::DOUBLE)), 6) AS back4
FROM embeddings""")
def normalised(spark, folder):
    scaled = normalise(F.col("embedding").cast("array<double>"), MEAN, STD)
    frame = table(spark, folder, "embeddings").select("vec_id", scaled.alias("x"))
    back = denormalise(F.col("x"), MEAN, STD)
    return rounded(frame.select(
        "vec_id", F.col("x")[0].alias("x0"), F.col("x")[4].alias("x4"),
        F.col("x")[63].alias("x63"), back[4].alias("back4")), "x0", "x4", "x63", "back4")

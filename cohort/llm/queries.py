"""The registered queries of this subpackage, beside their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.llm.bag_minhash import near_duplicates
from cohort.llm.collocations import collocations
from cohort.llm.crf_language import with_languages
from cohort.llm.impact_index import top_inner_products
from cohort.llm.nbsvm import quality_scores
from cohort.llm.packing import pack
from cohort.llm.sanitise import personal_data, spans_text
from cohort.llm.shards import byte_shards
from cohort.llm.simhash_balls import simhash_components
from cohort.llm.suffix_dedup import repeated_bytes
from cohort.llm.url_templates import url_path, url_verdicts
from cohort.llm.whitening import whiten
from cohort.llm.winnowing import contamination

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that lie in a 100-byte string that also starts earlier."""
    return repeated_bytes(table(spark, sf_dir, "documents"))


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op2_url_templates")
def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url; a page takes the labels of the document that its path names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.withColumn("p", url_path(F.col("url"))).selectExpr(
        "page_id", "try_cast(regexp_extract(p, '/([0-9]+)', 1) AS bigint) AS doc_id")
    labels = named.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "page_id", "CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad")
    return url_verdicts(pages, labels, RULES)


@query("op3_sanitise")
def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document and the terms that disclose it."""
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"))


@query("op4_bag_minhash")
def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_copies", "class_size")


@query("op5_byte_shards", sql="""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
coded AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS codes
  FROM documents),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b:
    xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) AS crc FROM coded, polynomial),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, crc NULLS FIRST
                            ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc NULLS FIRST) AS nth,
    sum(size) OVER () AS total FROM summed),
cut AS (SELECT *, CAST((2 * upto - size) * 16 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law,
  shard, CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM cut""")
def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen contiguous shards of near-equal bytes."""
    return byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_best_fit")
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed as byte tokens, one more token for the end of each."""
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
                            .alias("length")))


def remainder(modulus: int, value: int):
    """Whether the checksum of the document id leaves this remainder; no id, no."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value,
                      F.lit(False))


@query("op7_crf_language")
def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    held_out = remainder(4, 2)
    rows = with_languages(table(spark, sf_dir, "documents"), held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "predicted.*")


@query("op8_nbsvm")
def op8_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                          remainder(3, 1))


@query("op9_impact_index", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x:
    CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1),
    lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 5""")
def op9_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return top_inner_products(table(spark, sf_dir, "embeddings"))


@query("op10_winnowing", sql="""
WITH dwords AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bwords AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, w[i:i + least(len(w), 10) - 1] AS run
  FROM bwords, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM windows),
runs AS (
  SELECT doc_id, i, m, w[i:i + m - 1] AS run
  FROM dwords, lengths, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
held AS (SELECT doc_id, i, runs.m, item_id FROM runs JOIN windows USING (m, run)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM held, unnest(range(i, i + m)) AS t(p)
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM held) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dwords LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a passage of the benchmark."""
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op11_collocations", sql="""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM spoken GROUP BY lang),
runs AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM spoken, range(1, 6) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
counted AS (
  SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, string_split(c.phrase, ' ') AS w
  FROM counted c, range(1, 5) AS s(k) WHERE k < c.m),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, l.f AS l, r.f AS r, n,
    (1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cut JOIN totals USING (lang)
  JOIN counted l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1:k], ' ')
  JOIN counted r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[k + 1:cut.m], ' ')),
best AS (
  SELECT * FROM scored c WHERE NOT EXISTS (
    SELECT 1 FROM counted o WHERE o.lang = c.lang AND len(o.phrase) > len(c.phrase)
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * o.f >= 100 * c.a)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words belong together most."""
    return collocations(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings on their first sixteen whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_simhash_balls")
def op13_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of near copies of each document."""
    return simhash_components(table(spark, sf_dir, "documents"))

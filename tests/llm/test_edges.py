"""Odd, repeated and missing rows through every operator."""

import pytest
from pyspark.sql import functions as F

from cohort.llm.bag_minhash import near_duplicates
from cohort.llm.crf_language import with_languages
from cohort.llm.impact_index import top_inner_products
from cohort.llm.nbsvm import quality_scores
from cohort.llm.packing import pack
from cohort.llm.sanitise import personal_data, sanitise
from cohort.llm.shards import byte_shards
from cohort.llm.suffix_dedup import repeated_bytes
from cohort.llm.url_templates import url_verdicts
from cohort.llm.winnowing import contamination



def no():
    return F.lit(False)


def items(docs):
    return docs.select(F.col("doc_id").alias("item_id"), "text", "key")


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), "key")


PER_ROW = {
    "suffix": repeated_bytes, "minhash": near_duplicates, "personal": personal_data,
    "sanitise": sanitise, "shards": byte_shards,
    "language": lambda d: with_languages(d, no()).select("doc_id", "predicted.*"),
    "quality": lambda d: quality_scores(d, labels(d), no()),
    "winnowing": lambda d: contamination(d, items(d)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_each_row_has_a_result(odd_docs, name):
    rows = PER_ROW[name](odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(
        str(r["doc_id"]) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_no_rows(no_docs, name):
    assert PER_ROW[name](no_docs).collect() == []


def test_near_copies_of_odd_rows(odd_docs):
    rows = near_duplicates(odd_docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[7][0]["class_id"] == 6 and by[7][0]["class_size"] == 2
    assert by[1][0]["class_id"] == 1 and by[2][0]["class_id"] == 2  # no words: alone
    assert all(r["class_size"] == 5 and r["class_id"] is None for r in by[11])
    assert sum(r["first"] for r in by[11]) == 0


def test_shards_of_odd_rows(odd_docs):
    rows = byte_shards(odd_docs, shards=4).collect()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(
            range(sum(r["shard"] == s for r in rows)))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {
        (1, None), (1, 0)}


def test_packing_of_odd_rows(odd_docs, no_docs):
    lengths = odd_docs.withColumn("length", F.length("text"))
    rows = pack(lengths, capacities=(100, 1000, 5000)).collect()
    whole = sum(r[0] or 0 for r in lengths.select("length").collect())
    assert sum(r["length"] for r in rows) == whole
    assert pack(no_docs.withColumn("length", F.length("text"))).collect() == []


def test_urls_of_odd_rows(spark, odd_docs, no_docs):
    urls = odd_docs.withColumn("url", F.when(F.col("doc_id") != 4, F.concat(
        F.lit("http://A.net/x/"), F.col("doc_id").cast("string")))).withColumnRenamed(
            "doc_id", "page_id")
    known = urls.select("page_id", F.lit(1).alias("bad"), "key")
    rows = url_verdicts(urls, known, []).collect()
    assert len(rows) == odd_docs.count()
    assert {r["verdict"] for r in rows if r["host"] == "a.net"} == {"block"}
    empty = no_docs.withColumnsRenamed({"doc_id": "page_id", "text": "url"})
    assert url_verdicts(empty, known, []).collect() == []
    assert {r["verdict"] for r in url_verdicts(urls, known.limit(0), []).collect()} == {"allow"}


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, None),
            (None, [1.0, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (50, [0.5, 0.5]),
            (8, [1.0, 0.5])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    rows = top_inner_products(vectors.withColumn("row", F.lit("x"))).collect()
    got = {q: [(r["rank"], r["vec_id"]) for r in sorted(rows, key=lambda r: r["rank"])
               if r["query_id"] == q] for q in (0, 50)}
    assert got == {0: [(1, 1), (2, 8), (3, 50)], 50: [(1, 0), (2, 1), (3, 8)]}
    assert top_inner_products(vectors.where("1 = 0")).collect() == []


def test_rows_that_repeat_a_key_are_partners(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [0.5])],
                                    "vec_id bigint, embedding array<float>")
    rows = top_inner_products(vectors).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == [
        (0, 1, 0, 131072), (0, 1, 0, 131072), (0, 2, 1, 32768), (0, 2, 1, 65536)]


def test_names_of_helpers_may_be_taken(odd_docs):
    docs = odd_docs.withColumns({c: F.lit("x") for c in ("i2", "i3", "t3", "clean", "t", "spans")})
    rows = sanitise(docs)
    assert rows.columns == docs.columns and rows.count() == docs.count()
    assert rows.where("clean = 'x' AND i3 = 'x'").count() == docs.count()

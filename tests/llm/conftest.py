import random

import pytest
from pyspark.sql import types as T

WORDS = ("the of and to in that is was for on with as it at by from this be are an or which one "
         "had not but what all were when we there can if their said who will more no way about "
         "many then them write would like so these her long make thing see him two has look day "
         "could go come did number sound most people my over know water than call first").split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: Columns whose names the operators use themselves.
EXTRA = ("key", "id", "tkey", "node", "start", "row", "piece", "bin", "n", "predicted", "h", "w")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null and repeated ids, repeated rows, ties, one long text, and
    columns with the operators' own names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    texts = [(0, prose(rng, 60)), (1, None), (2, ""), (3, "..."), (4, "word"), (None, prose(rng, 30)),
             (None, None), (5, prose(rng, 40)), (5, prose(rng, 40)), (6, long), (7, long),
             (8, "a" * 3000), (9, "é" * 300), (10, "12 34 56")]
    texts += [(11, "same text again " * 10)] * 3 + [(None, "same text again " * 10)] * 2
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in EXTRA)])
    rows = [(i, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None, None if t is None
             else len(t), *["x"] * len(EXTRA)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")

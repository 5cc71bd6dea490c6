import random

import pytest
from pyspark.sql import types as T

#: Names that operators use inside; inputs may have them too.
CLASHES = ["fp", "row", "key", "size", "mix", "cut", "spans", "score", "position", "doc", "chunk", "start", "kept_id",
           "copy_number", "pass", "span_doc", "found", "host", "form"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("source", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHES])


def invented(words, seed, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rnd.random() ** 2)}" + rnd.choice(["", "", "", ",", ".", "\n", "é"]) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, an id with two texts."""
    passage = invented(60, 1)
    texts = [None, "", "  \n\t ", "one", "two words", invented(30_000, 2), passage, passage, passage + " " + invented(50, 3),
             invented(40, 4) + "\n" + passage, "Idiot! you IDIOT, trash...", "a b 　 c", "x" * 50_000, "| | | ***"]
    rows = [(n, t, f"s{n % 3}" if n % 5 else None) for n, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, passage, None), (None, None, "s1"), (3, "another text of this id", "s9")]
    return rows + [(100 + n, invented(120, 50 + n), f"s{n % 4}") for n in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(*r, *CLASHES) for r in odd_rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")


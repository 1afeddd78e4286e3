import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["ka", "lo", "mi", "té", "ru", "sen"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty texts, copies, repeated rows, shared passages, odd white space, one long text and clashing columns."""
    rnd = random.Random(5)
    shared = prose(rnd, 90)
    rows = [(i, prose(rnd, rnd.randint(60, 120)) + "\n" + prose(rnd, 12)) for i in range(12)]
    rows += [(20, rows[0][1]), (21, rows[0][1]), (22, None), (23, ""), (24, " \t\n\n "), (25, "one"), (26, "one"), (27, shared + " tail"), (28, "head " + shared)]
    rows += [(29, rows[1][1] + " extra"), (30, "a  b\t c\r\n d\n\n\ne  "), (31, "x" * 400), (32, "same line here now\n" * 40), (33, prose(rnd, 9000)), (33, None), (34, "tie"), (34, "tie")]
    rows += [(None, "no key, " + shared), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("score", "n_words", "component_id", "key", "doc", "a", "start", "kept", "lines", "contaminated", "posterior"):
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def plain(awkward):
    """The same without null or repeated keys, as a list too."""
    df = awkward.where("doc_id is not null and doc_id not in (33, 34)").select("doc_id", "text")
    return df, sorted((r.doc_id, r.text or "") for r in df.collect())


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)

import pytest
from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHING = ("row", "score", "sid", "h", "n", "bits", "shard", "copy", "leaks", "part", "sketch", "epochs", "size", "bytes", "hash", "id", "nth", "spans", "lang_code", "x0", "plan_source", "gone_id", "refers_to", "block", "anchor", "token", "doc_a", "toxic", "item_id")
LONG = " ".join(f"word{i % 977} item{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(70))


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ids and texts, clashing names."""
    rows = [
        (None, "a text without an id " * 5, "en", "src0", 100), (1, None, "en", "src0", None), (2, "", "de", "src1", 0), (3, "  \n\t ", None, "src1", 5), (4, LONG, "en", "src0", None),
        (5, "one two three four five six seven eight nine ten", "en", None, 48), (5, "one two three four five six seven eight nine ten", "en", None, 48), (6, "one two three four five six seven eight nine ten", "en", "src2", 48),
        (7, "one two three four five six seven eight nine eleven", None, None, None), (7, "another text under the same id", "fr", "src2", 30), (8, "Straße ÉCOLE naïve 日本語 \u0000 😀", "de", "src2", 20), (9, "word", "en", "src3", 4),
        (10, f"before the first {PASSAGE} and after it", "en", "src3", 600), (11, f"a second copy {PASSAGE}", "en", "src3", 600), (None, None, None, None, None), (None, f"nameless {PASSAGE}", "en", "src4", 600),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(CLASHING):
        d = d.withColumn(name, F.lit(None).cast("string") if i % 3 == 0 else F.lit(i))
    return d


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (5, 1, None), (999, 0, 1), (6, None, 0), (6, 1, 0), (11, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, None), (3, ""), (4, "too short"), (5, "one two three four five six seven eight nine ten")], "item_id long, text string")

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("kept", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("length", T.StringType()),
    ]
)


def rows_of(pairs):
    return [(i, t, "en", s, None if t is None else len(t), "x", None, 7, "y") for i, t, s in pairs]


#: Null ids, null and empty and all-white texts, ties, repeated rows, very long texts, odd characters.
EDGES = [
    (None, "no id here", "a"),
    (1, None, None),
    (2, "", "a"),
    (3, " \t\n", "a"),
    (4, "one two three four five six seven eight nine ten", "a"),
    (5, "one two three four  five six seven eight nine ten", "b"),
    (6, "one two three four five six seven eight nine ten", "b"),
    (6, "one two three four five six seven eight nine ten", "b"),
    (7, "Mail bob@example.com or 10.0.0.1 or +1 (663) 555-6869 now", "a"),
    (8, "😀 " * 300 + "bob@example.com", "hot"),
    (9, "x" * 200_000, "hot"),
    (10, "word " * 30_000, "hot"),
    (11, "a\x1cb \x1cc d  e <|endoftext|> f  <|endoftext|>\n\n  g", "a"),
    (12, "1" * 30_000, "b"),
    (13, "a" * 9 + "@" + "b.c" * 4000, "b"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(rows_of(EDGES), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

import pytest

SF = "/root/testdata/sf0.001"
EXTRA = [
    (9001, None), (9002, ""), (9003, " \t\n "), (9004, "one two three"), (9005, "one two three"), (9006, "One two THREE"),
    (9007, "Und " * 300), (9008, "word " * 20_000), (9009, "\n".join(f"line number {i} of the hot text" for i in range(40))),
    (9010, "\n".join(f"line number {i} of the hot text" for i in range(40))), (9010, "\n".join(f"line number {i} of the hot text" for i in range(40))),
    (9011, "x" * 5000), (9012, "é ñ 中文 😀 \x1c a b <|endoftext|> İ!!"), (9013, "a b\nc d\n\n" + "\n".join(f"line number {i} of the hot text" for i in range(5, 12))),
]


@pytest.fixture(scope="session")
def docs(spark):
    """200 generated texts, and nulls, empties, copies, a repeated row, very long and odd ones."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en" if i % 2 else None, "edge", None) for i, t in EXTRA], rows.schema)
    return rows.unionByName(extra).coalesce(4).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def items(spark):
    rows = spark.read.parquet(f"{SF}/benchmark.parquet")
    return rows.unionByName(spark.createDataFrame([(7001, None), (7002, "..."), (7003, "line number 7")], rows.schema))

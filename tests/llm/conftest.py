import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i * 7919 % 10007}x" for i in range(300))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, LONG), (6, LONG), (6, LONG), (None, LONG[:1500] + " tail"),
    (7, LONG.replace(" w", " W", 3)), (8, LONG[30:] + " end of it"), (9, "a" * 3000), (10, "x " * 2000),
    (11, "Licensed under the Apache License, Version 2.0. MIT License here. mail a.b@c.example.org or +1 (626) 555-5759"),
    (12, "card 4111 1111 1111 1111 ip 10.0.0.255 and 300.1.1.1 é漢字😀 <|endoftext|> 's x"), (13, LONG.split(" ", 40)[40]),
]


@pytest.fixture(scope="package")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t, ["en", None][n % 2], ["s", None, "r"][n % 3], n, "x") for n, (i, t) in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, h string")
    for name in ("_w", "body", "node", "row", "rank", "key", "n", "k", "spans", "ids", "kept", "window"):
        frame = frame.withColumn(name, F.lit(1))
    return frame


@pytest.fixture(scope="package")
def nothing(docs):
    return docs.limit(0)

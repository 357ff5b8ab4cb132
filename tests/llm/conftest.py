import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


#: Nulls, empty and long texts, ties and repeated rows, an extra column that clashes with an operator's own.
ROWS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two  three\nfour five six seven eight nine ten"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "ONE two three four five six seven eight nine ten"),
    (7, "short text"),
    (7, "short text"),
    (None, "text of nobody and of no number at all"),
    (8, "paragraph one.\nparagraph two.\nparagraph three."),
    (9, "paragraph three.\nparagraph one.\nparagraph two."),
    (10, "long words stand here " * 9000),
    (11, "…12 ²½ 漢字 \x1c ǰ́"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if t and "text" in t else None, "s", 0, -1, "x") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

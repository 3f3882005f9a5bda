import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("pairlens-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


ROWS = [
    (1, 1, 2, "How do I learn Spark?", "What is the best way to learn Spark?", 1, "train"),
    (2, 3, 3, "Why?", "Why?", 1, "train"),
    (3, 4, 5, None, "Who is there?", 0, "train"),
    (4, 6, 7, "the of and", "Is it?", 0, "train"),
    (5, 8, 9, "What's new, can't wait", "I'm sure they'll show", 0, "train"),
    (6, 10, 11, "visit the usa now", "visit the uk now", 0, "train"),
    (7, 12, 13, "Über ÉCOLE", "école über", 1, "train"),
    (8, 14, 15, "data data data", "data lake", 0, "test"),
    (9, 16, 17, 'a "quoted", text', "x, y", 0, "train"),
    (10, 18, 19, " ".join(f"w{i}" for i in range(45)), "w1", 0, "train"),
    (11, 20, 21, "A b", "C d", 0, "train"),
    (12, 20, 21, "A b", "C d", 0, "test"),
    (13, 21, 20, "C d", "A b", 0, "train"),
]
SCHEMA = "id long, id1 long, id2 long, question1 string, question2 string, is_duplicate int, split string"


@pytest.fixture(scope="session")
def pairs(spark):
    from pairlens.sources.pairs import fill_text
    from pairlens.staging import stage
    return stage(fill_text(spark.createDataFrame(ROWS, SCHEMA)), "hand-pairs")


def by_id(df):
    return {r["id"]: r.asDict() for r in df.collect()}

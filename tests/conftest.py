import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lectern.sources.corpus import BOOKS, PASSAGES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# idx, name, Chinese name, chapters, English aliases, Chinese aliases. Thirty verses a chapter.
BOOK_ROWS = [
    (1, "Genesis", "创世记", 50, ["gen", "gn"], ["创世记", "创"]),
    (6, "Joshua", "约书亚记", 24, ["josh"], ["约书亚记", "书"]),
    (19, "Psalms", "诗篇", 150, ["ps", "psalm"], ["诗篇", "诗"]),
    (22, "Song of Songs", "雅歌", 8, ["sos", "ss"], ["雅歌", "歌"]),
    (35, "Habakkuk", "哈巴谷书", 3, ["hab", "hb"], ["哈巴谷书", "哈"]),
    (43, "John", "约翰福音", 21, ["jn", "john"], ["约翰福音", "约"]),
    (58, "Hebrews", "希伯来书", 13, ["heb", "hb"], ["希伯来书", "来"]),
    (62, "1 John", "约翰一书", 5, ["1 jn", "1jn"], ["约翰一书", "约一"]),
    (65, "Jude", "犹大书", 1, ["jude", "jd"], ["犹大书", "犹"]),
    (66, "Revelation", "启示录", 22, ["rev"], ["启示录", "启"]),
]


@pytest.fixture(scope="session")
def books(spark):
    rows = [(i, n[:3], n, c, [30] * k, ea, ca) for i, n, c, k, ea, ca in BOOK_ROWS]
    df = spark.createDataFrame(rows, BOOKS)
    return df.selectExpr("idx as book_pos", "*").cache()


# A small canon: book 2 has no chapters, idx 5 is missing, chapter 3 of book 1 is empty.
CANON = [
    (1, "One", "一书", [3, 2, 4]),
    (2, "Two", None, []),
    (3, "Three", "三书", [2]),
    (4, "Four", "", [2, 2]),
    (6, "Six", "六书", [1]),
]

# row, book, chapter, verse, English, Chinese
VERSES = [
    (0, 1, 1, 0, "A psalm of one spirit", "诗歌"),
    (1, 1, 1, 1, "They were joined to the Lord in one spirit", "神爱世人"),
    (2, 1, 1, 3, "One spiritual word & <another> one", ""),
    (3, 1, 1, 9, "Beyond the count: spirit one", "爱神"),
    (4, 1, 2, 1, "The word, one word", None),
    (5, 1, 2, 2, "Joining spirits", "人神相爱"),
    (6, 3, 1, 1, "Christ's love", "基督"),
    (7, 3, 1, 2, "love one another", "世人爱神 神爱"),
    (8, 4, 1, 1, "R&D amp lamp", "督基"),
    (9, 4, 2, 2, "It ends", "完"),
    (10, 3, 1, 1, "Christ's love again", "基督的爱"),
    (11, 6, 1, 1, None, "爱人神爱"),
]


@pytest.fixture(scope="session")
def canon(spark):
    rows = [(i, n, n, c, ch, [n.lower()], [c] if c else []) for i, n, c, ch in CANON]
    return spark.createDataFrame(rows, BOOKS).selectExpr("idx as book_pos", "*").cache()


@pytest.fixture(scope="session")
def verses(spark):
    return spark.createDataFrame(VERSES, PASSAGES).cache()


@pytest.fixture(scope="session")
def corpus(verses):
    from lectern.operators.search import index_corpus

    return index_corpus(verses, addresses=True)

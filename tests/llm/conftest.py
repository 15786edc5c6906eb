import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")  # many small products: threads only get in each other's way
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) + os.pathsep + os.environ.get("PYTHONPATH", "")

LONG = " ".join(f"Wört{i % 977} x{i}" for i in range(30_000))
COPY = "The cat sat on the mat and looked at the old dog by the door while rain fell on the quiet street of the town " * 2
#: (doc_id, text, lang, source)
ROWS = [
    (1, COPY, "en", "a"), (2, COPY, "en", "a"), (3, COPY + "today", "en", "b"), (4, COPY, None, None), (5, "", "en", "b"), (6, None, "de", "c"),
    (7, " \t\n ", "fr", "a"), (8, LONG, "de", "a"), (8, LONG, "de", "a"), (9, "one", "en", None), (10, "one two", "en", "é"), (None, "no id here at all", "en", "a"),
    (None, "no id here at all", "en", "a"), (11, "a a a a a a\nsame line\nsame line\n\nsame line", "en", "b"), (12, "Mail x.y+z@mail.example.com or +1 (202) 555-0147, card 4111 1111 1111 1111, host 10.0.0.255 and 10.0.0.256", "en", "b"),
    (13, "emoji 😀 한국어 naïve ▁mark <|endoftext|> it's", "xx", "c"), (-14, "negative id", "en", "a"), (20, "tie one", "en", "d"), (21, "tie two", "en", "d"), (22, "tie one", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, data string, fp long, score double, size string, shard string, key string, part int, taken int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, repeats, empty and long texts, and columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, "clash", 1, 0.5, "clash", None, "clash", 3, None) for i, t, g, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (11, 0, 1), (12, 0, 1), (None, 1, 1), (13, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")

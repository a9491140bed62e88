import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

EDGE = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, score int, row int, held_out string, set int"
LONG = "Lorem ipsum dolor. " * 12_000


def edge_rows():
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"), (None, None), (7, LONG), (8, LONG), (9, "é ß 日本語 🙂   x"), (10, "x" * 30_000)]
    return [(i, t, None, "s", None, 7, "h", 1, 2, "no", 3) for i, t in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), EDGE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(100, 400)] + [(None, 1, 1), (101, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def labelled(spark):
    good = "The quiet river runs past the mill and the old stone bridge near town. "
    bad = "buy now !!! ### $$$ you total idiot "
    return spark.createDataFrame([(i, good * (1 + i % 3) if i % 2 else bad * (1 + i % 3)) for i in range(100, 400)], "doc_id long, text string")

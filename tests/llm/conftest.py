import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"
# names that the operators use inside
CLASHING = ("id", "batch", "bucket", "key", "mark", "n", "score", "size", "class", "component", "row", "label", "found", "lists")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with further columns of clashing names; rows are (doc_id, text[, source[, lang]])."""

    def make(rows, partitions=3):
        full = [(*r, *("s", "en")[len(r) - 2 :])[:4] + ("x",) * len(CLASHING) for r in rows]
        schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, texts that share an id, shared passages."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = text(40), text(30_000)
    near = passage.split()
    near[5] = "changed"
    return [
        (1, text(60) + " " + passage),
        (2, passage),
        (2, passage),
        (3, "  \t\n "),
        (4, None),
        (5, ""),
        (6, text(5) + "\n" + passage + "\r\n" + text(30)),
        (7, " ".join(near)),
        (8, long),
        (9, long[5_000:9_000] + " " + text(20)),
        (10, "und " * 400),
        (11, "und " * 200),
        (None, passage),
        (None, "alone"),
        (12, "one"),
        (13, "ONE"),
        (14, text(40)),
        (14, text(40)),
        (-3, passage.upper()),
    ]


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voucherlens.llm.queries import ready

sys.path.insert(0, str(Path(__file__).parent))

# Names that operators use inside, as extra columns of the input.
CLASHES = ["key", "n", "run", "row", "status", "block", "component", "text_hash", "place", "lines", "built"]

@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    ready(spark)


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents with extra columns, one of which is NULL throughout."""

    def make(rows, key="doc_id long"):
        made = spark.createDataFrame(rows, f"{key}, text string")
        made = made.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
        return made.withColumn("lang", F.lit(None).cast("string"))

    return make


@pytest.fixture(scope="session")
def corpus():
    """Rows with near and exact copies, shared passages, NULLs, empty and long texts, repeats."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(40), say(120).split()
    rows = []
    for i in range(60):
        lines = [say(rng.randint(3, 30)).capitalize() for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        rows.append((10 + i, "\n".join(lines)))
    for i in range(40):  # near copies: a few words differ
        copy = list(base)
        for _ in range(i % 9):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(copy[:60]) + "\n" + " ".join(copy[60:])))
    rows += [(300 + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(400, None), (401, ""), (402, "One two"), (403, "one TWO"), (404, "x"), (405, " \n\t "),
             (406, "ab" * 6000), (407, say(9000)), (408, "a" * 300), (None, rows[3][1]), (None, None)]
    rows += [rows[2], rows[2], (400, None)]  # repeated rows
    return rows

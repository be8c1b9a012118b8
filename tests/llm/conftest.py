"""Small awkward tables that every operator has to survive."""

import random

import pytest

from reelspark.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of an input.
CLASHES = ("fp", "score", "words", "token", "window", "kept", "base", "spans", "rank", "length", "part", "y", "root", "marks")


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    return ship(spark)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = "an be co du er fi go ha in jo ka lu mi no op ra se ti un ve".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, copies and near copies."""
    long_text = prose(1, 6000)
    near = prose(2, 300)
    texts = [
        None, "", "   \n\t", "one", "two words", prose(3, 80), prose(3, 80), near, near.replace(near.split()[150], "changed", 1),
        long_text, "x" * 20000, "Ünïcödé é " * 40, prose(4, 120) + "\n" + prose(4, 120), prose(5, 60) + " a.b@c.example.org 10.0.0.1",
        "same line\nsame line\n\nsame line " + prose(6, 60), "<|endoftext|> in a text " + prose(7, 20), "\x00 control \x1c\x85\xa0 " + prose(8, 55),
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 2 else "s", None if i % 5 else 1) for i, t in enumerate(texts)]
    return [*rows, (100, "repeated row " + prose(9, 60), "en", "s", 1), (100, "repeated row " + prose(9, 60), "en", "s", 1)]


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows in several partitions, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4)
    return df.withColumns({name: F.lit("extra") for name in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random
import re

import pytest
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns of documents, and one that clashes with names used inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("spans", T.StringType())])


def corpus(seed: int = 7, n: int = 60) -> list[tuple[int, str]]:
    """Texts with copies, near copies, shared passages, repeats, junk and secrets."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéfghïklmnoß") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = prose(60), []
    for i in range(n):
        kind = i % 10
        text = prose(rng.randint(3, 200))
        if kind == 1 and out:
            text = rng.choice(out)[1]
        elif kind == 2 and out:
            words = rng.choice(out)[1].split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edited"
            text = "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12))
        elif kind == 3:
            text = prose(20) + "\t" + passage + "\x0b" + prose(15)
        elif kind == 4:
            text = f'{prose(15)} api_key: "{rng.randrange(10**12):012d}ab" AKIA{"QWERTY7" * 3} {rng.getrandbits(160):040x} token=x'
        elif kind == 5:
            text = "The " * 200
        out.append((i, text))
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a repeated id, special tokens, other scripts, a long text."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, None), (None, "a null id with some words in it", None, None, None, None), (None, None, None, None, None, None), (2, "", "en", "s", 0, ""), (3, " \t\n", "en", "s", 3, ""),
            (4, "twice the very same row", "en", "s", 1, ""), (4, "twice the very same row", "en", "s", 1, ""), (4, "one id with another text", "en", "s", 1, ""), (5, "<|endoftext|> and <|startoftext|> ½ ² 日本語 á \U0001f600", "en", "s", 1, ""), (6, long, "en", "s", 1, ""), (7, long, "en", "s", 1, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, ids string"
SYLLABLES = "an the re tion of ba lo mi est und que la".split()


def prose(rnd: random.Random, words: int) -> str:
    out = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4))) for _ in range(words)]
    return " ".join(w.capitalize() + "." if k % 11 == 10 else w for k, w in enumerate(out))


def hard_rows() -> list[tuple]:
    """Nulls everywhere, empty and long texts, ties, repeated rows, odd characters, near copies; extra columns whose names operators use."""
    rnd = random.Random(7)
    base = prose(rnd, 120)
    words = base.split()
    texts = [prose(rnd, rnd.randrange(1, 80)) for _ in range(40)]
    texts += [base, base, base, " ".join(["changed", *words[1:]]), " ".join([*words[:-1], "other"]), " ".join(words[:60] + ["here"] + words[61:])]
    texts += [None, None, "", "", " \n\t ", "x", "é漢🙂 \r\n a  b", prose(rnd, 30_000), "y" * 5_000, "Licensed under the Apache License, Version 2.0.", "GNU general public LICENSE. cc by; CC-BY 4.0", "and&&& of### the*** " * 20]
    rows = [(k, t, "en", "src1", None if t is None else len(t), 0.5, "mine", "i") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique(hard):
    """One row for each id."""
    return hard.filter("doc_id is not null").dropDuplicates(["doc_id"])

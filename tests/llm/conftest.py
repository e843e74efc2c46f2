"""Small documents with what the operators must cope with."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = prose(60)
    base = prose(150)
    texts = [prose(rng.randint(20, 200)) for _ in range(25)]
    texts += [base, base, base + " ", base.upper()]  # copies
    for k in (1, 2, 4, 9, 16):  # near copies
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{prose(40)}\n{shared}\n{prose(30)}" for _ in range(3)]  # a passage that repeats
    texts += [shared + " " + shared, "x " * 400, prose(9000), "one two", "one two", "a", "", " \n\t ", None, None]
    texts += ["Line one here\nLine one here\nother line\n\n", "!!! ### $$$", "été dans l'Île <|endoftext|> ß 日本"]
    texts += [f"{prose(30)}\nReleased under the MIT License.\nAll rights reserved."]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[28]]  # repeated rows
    rows += [(None, base, "en", None, None), (None, None, None, None, None), (None, prose(50), None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Written and read again, with columns whose names might clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({"score": F.lit("x"), "row": F.lit(1), "kept": F.lit(None).cast("string"), "_id": F.lit(2), "bucket": F.lit(3)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

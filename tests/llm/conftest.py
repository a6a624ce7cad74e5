import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        T.StructField("digest", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("rows", T.StringType()),
        T.StructField("word", T.StringType()),
    ]
)
SYLLABLES = {"en": "the and ing er tion ou".split(), "de": "sch ein ung ich zu ü".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def odd_texts():
    rng = random.Random(4)
    shared = prose(rng, "en", 60)
    texts = [None, "", "   \n\t ", "a", "Ünïcode  und\xa0mehr ▁ <|endoftext|> 日本", "x" * 3000, "word " * 400, "12 34 %% $$ ##"]
    texts += [shared, shared, shared + " tail", "Head " + shared, prose(rng, "de", 5000) + " " + shared]
    texts += ["line one\nline two\n\n\nline one\n" * 5, "same\n" * 30]
    for i in range(40):
        texts.append(prose(rng, "de" if i % 3 else "en", rng.randint(3, 200)))
    return texts


@pytest.fixture(scope="session")
def odd(spark):
    rows = []
    for i, text in enumerate(odd_texts()):
        rows.append((i, text, [None, "en", "de"][i % 3], [None, "b", "a", "Z"][i % 4], None, "x", None, "y", "z", "w"))
    rows.append((7, "a", "en", "b", 1, "x", None, "y", "z", "w"))
    rows.append((None, "a", None, "b", 1, "x", None, "y", "z", "w"))
    rows.append((8, rows[8][1], "en", None, 1, "x", None, "y", "z", "w"))
    rows.append((8, rows[8][1], "en", None, 1, "x", None, "y", "z", "w"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

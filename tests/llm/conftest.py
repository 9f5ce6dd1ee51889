import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "ve", "xu", "The", "éa", "don't", "A1"]


def passage(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with what breaks code: nulls, empty and long texts, copies, ties, odd characters."""
    rng = random.Random(11)
    shared = "\n".join(passage(rng, 14) for _ in range(6))
    texts = [None, "", " \n\t", "one", "a b", "a b c", "\n\n\n", "x" * 500, "ab" * 400, "\0" * 300, "日本語 テキスト " * 30, "<|endoftext|> and <|startoftext|>", "Σσς İ ﬁ ½"]
    texts += [passage(rng, 60) for _ in range(12)]
    texts += [passage(rng, 30) + "\n" + shared + "\n" + passage(rng, 25) for _ in range(8)]
    base = passage(rng, 300)
    texts += [base, base, base, base + " end", "start " + base, base.upper(), base.replace("ka", "kA", 1)]
    texts += ["\n".join(passage(rng, 9) for _ in range(400)), passage(rng, 20_000), "\n".join(["same line here"] * 40), passage(rng, 12) * 8]
    sources = ["a", "b", "c", None, "é", "b"]
    rows = [(i * 3, t, "en", sources[0] if i % 3 == 0 else rng.choice(sources), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, "row without id " + passage(rng, 30), None, None, None), rows[-1], (7, None, None, None, None), (7, shared, "en", "a", 1)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with more columns, some named like those the operators make."""
    from pyspark.sql import functions as F

    more = ("kept", "n_words", "ids", "fp", "size", "copies", "target", "component", "_d", "_m", "_drop", "_new", "_left", "_k", "key", "a", "b")
    return documents.withColumns({c: F.lit("clash") for c in more})

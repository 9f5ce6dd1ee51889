"""SimHash's survivors where ids are null or repeated."""

import random

from tidemark.llm import simhash

from .conftest import KIND, passage


def test_each_component_keeps_one_row(spark):
    rng = random.Random(23)
    a, b, c, d = (passage(rng, 40) for _ in range(4))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, c), (3, d)]
    got = simhash.keep_one(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND)).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted([(None, a), (None, b), (7, c), (3, d)], key=repr)

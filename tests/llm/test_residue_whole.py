"""The models are fitted on all documents."""

import random

import numpy as np

from corpuskiln.llm import residue as R
from tests.llm.test_residue import prose


def test_every_document_is_counted(spark):
    r = random.Random(3)
    texts = [prose(r, r.randint(1, 4)) + "\nLorem ipsum dolor sit amet" * (i % 9 == 0) for i in range(6000)] + [prose(r, 4000), "\n\n", "x"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    model = R.train(texts[:50])
    want = R.count(texts, model)
    for parts in (3, 7):  # nor does it matter how the rows are split
        assert (R.count_all(df.repartition(parts), model) == want).all()
    n = R.count_all(df, None)
    assert n[R.AT_LINES] == sum(bool(ln.strip()) for t in texts for ln in t.split("\n"))
    assert n[: R.AT3].sum() == sum(max(0, len(t.strip()) + 1 - (R.N - 1)) for t in texts)


def test_models_are_of_all_rows(spark):
    r = random.Random(8)
    rows = [prose(r, 3) for _ in range(4500)] + ["Lorem ipsum dolor sit amet, consectetur adipiscing elit. Zwhq vlopt krempf"] * 3
    model = R.fit_on(spark.createDataFrame([(t,) for t in rows], "text string"))
    assert all(np.allclose(a, b) for a, b in zip(model, R.train(rows)))

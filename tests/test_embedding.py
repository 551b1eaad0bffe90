"""The seam for embedding models."""

import numpy as np
import pytest

from quillon.operators import vectors


def test_texts_are_embedded_in_batches(spark):
    def model():
        def encode(texts):
            if len(texts) > 4:
                raise AssertionError("batch too large")
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[len(t), t.count("a")] for t in texts]

        return encode

    data = [(i, "a" * (i + 1), "x") for i in range(9)] + [(20, None, "x"), (21, "", "x"), (22, "", "y"), (22, "", "y")]
    df = spark.createDataFrame(data, "id long, text string, vector string").coalesce(1)
    got = vectors.embedded(df, model, batch=4).collect()
    assert len(got) == 13 and {r.status for r in got} == {"embedded", "skipped"}
    of = {r.id: r for r in got}
    assert of[20].vector is None and of[20].status == "skipped" and list(of[21].vector) == [0.0, 0.0]
    assert np.allclose(of[3].vector, [2**-0.5] * 2)
    mixed = vectors.embedded(spark.createDataFrame([(i, "bad" if i == 5 else "ok") for i in range(8)], "id long, text string").coalesce(1), model, batch=4).collect()
    assert sorted((r.id, r.status, r.error) for r in mixed) == [(i, "embedded", None) for i in range(4)] + [(i, "error", "ValueError: no") for i in range(4, 8)]
    assert vectors.embedded(df.where("false"), model).count() == 0


@pytest.mark.parametrize("shape", [(3,), (1, 2)])
def test_a_model_must_give_a_row_for_each_text(spark, shape):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string").coalesce(1)
    got = vectors.embedded(df, lambda: lambda texts: np.zeros(shape)).collect()
    assert [r.status for r in got] == ["error"] * 3 and all("shape" in r.error for r in got)

"""All labels decide: the cut over ranges of scores is that of all rows in one array, and no label is left out."""

import numpy as np
import pytest

from caudal.llm import quality


@pytest.mark.parametrize("seed", range(3))
def test_cut_over_ranges_is_that_of_all_rows(spark, seed):
    rng = np.random.default_rng(seed)
    scores, good = np.round(rng.normal(size=400), 1 if seed else 9), rng.random(400) < 0.5
    found = spark.createDataFrame([(i, 60, 300, 0, 0, 0, float(x)) for i, x in enumerate(scores)], quality.FEATURES)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(good)] + [(None, 1), (7, None)], "doc_id long, quality int")
    assert quality.cut(found, quality.labelled(labels)) == pytest.approx(quality.threshold(scores, good), abs=1e-9)
    assert quality.cut(found, quality.labelled(labels.filter("quality = 1"))) == -np.inf


def test_all_labels_are_read(spark):
    labels = spark.range(0, 30_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    known = quality.labelled(labels)
    assert known.count() == 30_000 and known.filter("good").count() == 15_000
    docs = spark.createDataFrame([(29_999, "wxyz"), (29_998, "wxyz"), (None, "abcd")], "doc_id long, text string")
    marked = docs.join(known, "doc_id", "left").selectExpr("coalesce(good, false) AS good", "text")
    raw, target = quality.multinomials(marked)
    assert (raw.sum(), target.sum()) == (3, 1)

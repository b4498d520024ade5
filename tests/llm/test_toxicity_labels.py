"""All labelled rows are learned from, dealt in shards; cuts over counted scores are those of all rows in one array."""

import numpy as np
import pytest

from caudal.llm import shared, toxicity


def test_every_label_is_learned_from(spark, monkeypatch):
    """At most TRAIN_ROWS (8,000) of them were, on the driver."""
    shared.small_batches(spark)
    docs = spark.range(0, 12_000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN 'you awful scum' ELSE 'a good friend' END AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS int) AS toxic")
    rows = toxicity.labelled(docs.union(docs.limit(50)), labels.union(labels.selectExpr("doc_id", "1 - toxic").limit(9)))
    wanted = docs.filter(~toxicity.held_out(docs["doc_id"])).count()
    counted = toxicity.summed(rows, lambda batches: ((0, 1, np.full(toxicity.BLOCKS, float(len(toxic)))) for _, _, toxic, _, _ in toxicity.rows_of(batches)))
    assert wanted > 9_000 and set(counted) == {wanted}
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2000)
    model, by, overall = toxicity.fit(docs, labels)
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in toxicity.score(docs.limit(400), model).collect())
    assert by == {"en": overall} and 0 < overall < 1


@pytest.mark.parametrize("seed", range(3))
def test_cuts_are_those_of_all_rows(spark, seed):
    rng = np.random.default_rng(seed)
    toxic, lang = rng.random(400) < 0.3, np.array(["en", "de", "", "xx"])[rng.choice(4, 400, p=[0.5, 0.3, 0.17, 0.03])]
    scores = np.round(np.clip(rng.normal(0.4 + 0.2 * toxic, 0.2), 0, 1), 1 if seed else 6)
    rows = [(None if x == "" and i % 2 else str(x), float(y), bool(z)) for i, (x, y, z) in enumerate(zip(lang, scores, toxic, strict=True))]
    by, overall = toxicity.cuts(spark.createDataFrame(rows, "lang string, score double, toxic boolean"))
    assert overall == pytest.approx(toxicity.calibrated(scores, toxic), abs=2e-6)
    assert by == {x: pytest.approx(toxicity.calibrated(scores[lang == x], toxic[lang == x], overall), abs=2e-6) for x in ("en", "de", "xx")}

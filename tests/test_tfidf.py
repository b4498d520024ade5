"""TF-IDF matches against a plain program; no term of a text is a row by itself, so that a term moves once a block."""

import math
import random
from collections import Counter

from caudal.operators import corpus


def brute(queries, docs, n=5):
    def side(rows):
        out = {}
        for id_, text in rows:
            w = (text or "").split()
            out.setdefault(id_, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        return out

    q, d = side(queries), side(docs)
    df = Counter(t for s in (q, d) for c in s.values() for t in c)
    weights = lambda c: {t: (1 + math.log(k)) * (math.log((1 + len(queries) + len(docs)) / (1 + df[t])) + 1) for t, k in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    out = set()
    for i, a in ((i, weights(c)) for i, c in q.items() if i is not None):
        scores = [(round(sum(a[t] * b[t] for t in a.keys() & b.keys()) / norm(a) / norm(b), 6), j) for j, b in ((j, weights(c)) for j, c in d.items() if j is not None) if a.keys() & b.keys()]
        ranked = sorted(scores, key=lambda x: (-x[0], x[1]))[:n]
        best = ranked[0][0] if ranked else 0
        out |= {(i, j, s, best < 0.2) for p, (s, j) in enumerate(ranked) if s >= max(0.2, best * 0.75, best - 0.08) or (p == 0 and best < 0.2)}
    return out


def test_matches_are_those_of_a_plain_program_and_terms_do_not_move_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 300)
    monkeypatch.setattr(corpus, "CELLS", 50)
    rng = random.Random(4)
    text = lambda most: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice((1, 2)) for _ in range(rng.randrange(most)))
    copy = text(40)
    docs = [(i, text(60)) for i in range(150)] + [(i, copy) for i in range(150, 170)] + [(3, "a b c"), (3, "c d"), (None, "a b"), (None, "c"), (171, None), (172, "")]
    queries = [(f"q{i}", text(20)) for i in range(30)] + [("q1", "x y z"), (None, "a b"), ("copy", copy), ("none", "0"), ("null", None)]
    docs_df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3).localCheckpoint()
    found = corpus.tfidf_matches(spark.createDataFrame(queries, "item string, text string"), docs_df, "item", "doc_id")
    assert {tuple(r) for r in found.collect()} == brute(queries, docs)
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_no_rows(spark):
    queries, docs = spark.createDataFrame([("q", "a")], "item string, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert corpus.tfidf_matches(queries, docs.filter("false"), "item", "doc_id").count() == 0
    assert corpus.tfidf_matches(queries.filter("false"), docs, "item", "doc_id").count() == 0
    assert corpus.tfidf_matches(queries, docs, "item", "doc_id").count() == 1

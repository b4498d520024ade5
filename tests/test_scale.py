"""Steps that were changed so that little moves: what they must not lose, and that they move no more."""

import numpy as np
from pyspark.sql import functions as F

from caudal.functions import text as T
from caudal.operators import alignment, corpus


def _moved(df):
    """Spark's plan, as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_keywords_of_texts_that_share_an_id(spark):
    rows = [(1, "bbb aaa bbb ccc aaa"), (2, "aaa zzz"), (2, "zzz kkk zzz"), (None, "ooo"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = {(r.id, r.place): (r.term, r.tf) for r in corpus.keywords(docs, "id", 2).collect()}
    assert found == {(1, 1): ("bbb", 2), (1, 2): ("aaa", 2), (2, 1): ("zzz", 3), (2, 2): ("aaa", 1), (None, 1): ("ooo", 1)}
    alone = corpus.keywords(docs.filter("id = 1"), "id", 2)
    assert "Exchange" not in _moved(alone) and [(r.term, r.place) for r in alone.orderBy("place").collect()] == [("bbb", 1), ("aaa", 2)]


def test_nearest_with_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(3)
    plain = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(60)]
    plain = [(i, v if any(v) else [1.0, 0, 0, 0]) for i, v in plain] + [(60 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(9)]
    rows = plain + [(100, [1.0, None, 0.0, 1.0]), (101, None), (102, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = vectors.filter("vec_id in (3, 61, 100)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    found = {}
    for r in corpus.nearest(vectors, asked, 4, block=1).collect():
        found.setdefault(r.query_id, set()).add((r.vec_id, r.score))
    for q in (3, 61):
        x = np.array(dict(plain)[q])
        scores = sorted((-round(float(x @ v / np.sqrt((x @ x) * (v @ v))), 6), i) for i, v in ((i, np.array(v)) for i, v in plain) if i != q)
        assert found[q] == {(i, -s) for s, i in scores[:4]}
    assert len(found[100]) == 4 and all(s is None for _, s in found[100])
    assert "NestedLoopJoin" not in _moved(corpus._best_of(vectors, np.array([3]), np.array([[1.0, 0, 0, 0]]), 4))


def test_needles_and_affinity_move_only_what_is_asked(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 50}" for j in range(40))) for i in range(20)] + [(3, "a b c d e f g h a b c d e f g h")], "doc long, text string")
    asked = spark.createDataFrame([(0, "a b c d e f g h"), (1, "word1 word2 word3")], "item long, text string")
    found = corpus.needles(asked, docs, "item", "doc")
    assert [tuple(r) for r in found.collect()] == [(0, 3, 1)]
    assert "SortMergeJoin" not in _moved(found) and "SortMergeJoin" not in _moved(corpus.idf_affinity(asked, docs, "item", "doc"))


def test_number_core_stays_small(spark):
    x = T.number_core(F.col("x"))
    rows = spark.createDataFrame([("1.234,",), ("00012",), ("0,50",), ("1,234.5.",), ("1.2.3",), ("0.",), (",5",), (None,)], "x string")
    assert [r[0] for r in rows.select(x).collect()] == ["1234", "12", "0.5", "12345", "123", "0", "0.5", None]
    # each step names the one before a few times, and so names all steps before it the more often
    assert str(x).count("regexp_replace") < 20


def test_words_of_long_names_do_not_go_about_with_each_word(spark):
    names = spark.createDataFrame([("g", i, [f"w{j}" for j in range(i % 3, 300)]) for i in range(6)], "group string, id long, words array<string>")
    left, right = (alignment._classes(names.filter(f"id % 2 = {k}"), F.col("words")) for k in (0, 1))
    plan = _moved(alignment._alike(left, right, 0.6))
    # words are exploded beside the key of their class alone
    assert [line for line in plan.split("\n") if "Generate explode(words" in line] and all(", words#" not in line.split("explode(words")[1].split("[", 1)[1].split("]")[0] for line in plan.split("\n") if "Generate explode(words" in line)
    found = alignment.one_to_one(names.filter("id % 2 = 0"), names.filter("id % 2 = 1"), F.col("words")).collect()
    assert {(r.left_id, r.right_id) for r in found} == {(0, 3), (2, 5), (4, 1)}

"""Sequences, texts and selling rules on small rows with known results, and against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from caudal.functions import text as T
from caudal.operators import commerce, corpus, exams, relational, selling, structure


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_lessons_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([0, 5, 40, 90, 130, 250])) for k in range(6) for i in range(rng.randint(1, 30))]
    expected = set()
    for k in range(6):
        out, words = [], 0
        for _, i, w in [r for r in rows if r[0] == k]:
            if not out or words >= 120 or (words > 0 and words + w > 200):
                out.append([i, i, 0])
                words = 0
            words += w
            out[-1][1:] = [i, words]
        expected |= {(k, *x) for x in out}
    found = structure.lessons(spark.createDataFrame(rows, "k int, place int, words int"), "k", 120, 200)
    assert {(r.k, r["first"], r["last"], r.words) for r in found.collect()} == expected
    assert structure.lessons(spark.createDataFrame([], "k int, place int, words int"), "k", 1, 2).count() == 0


def test_paragraphs_headings_and_cut_words(spark):
    text = "CHAPTER ONE\nThe first line of a para-\n graph goes on here and there.\n\n\nanother one.\r\n1.2 numbered part\nlast"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n \n")], "id int, text string")
    found = {(r.id, r.place): (r.text, r["head"]) for r in structure.paragraphs(rows, "id").collect()}
    assert [found[k] for k in sorted(found)] == [("CHAPTER ONE", True), ("The first line of a paragraph goes on here and there.", False), ("another one.", False), ("1.2 numbered part", True), ("last", False)]


def test_ranges_are_repaired_and_faults_told(spark):
    rows = spark.createDataFrame([(1, 0, 4, 10, 1), (1, 3, 6, 10, 2), (1, 5, 6, 10, 3), (1, 8, 8, 10, 4), (2, 0, 9, 10, 1), (3, 5, 2, 10, 1)], "book int, start int, end int, size int, place int")
    fixed = sorted((r.book, r.start, r.end) for r in structure.repaired(rows, "book", "size").collect())
    assert fixed == [(1, 0, 4), (1, 5, 6), (1, 7, 9), (2, 0, 9)]
    assert {r.book: (r.fault, r.place) for r in structure.range_errors(rows, "book", "size").collect()} == {1: ("gap", 2), 3: ("gap", 1)}


def test_edits_sample_and_votes(spark):
    rows = spark.createDataFrame([("a b a", "b", "c"), ("a b a", "a", "c"), ("a", "x", "c"), ("a", "", "c"), (None, "a", "c")], "t string, f string, n string")
    assert [(r.t, r.status) for r in structure.replaced_once(rows, "t", "f", "n").collect()] == [("a c a", "done"), ("a b a", "ambiguous"), ("a", "missing"), ("a", "missing"), (None, "missing")]
    ids = spark.range(500)
    assert structure.sample(ids, "id", 20, 1).collect() == structure.sample(ids.repartition(7), "id", 20, 1).collect()
    assert [tuple(r) for r in structure.votes(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, c string"), "k", "c").orderBy("k").collect()] == [(1, "a", 1), (2, "c", 1)]


def test_text_functions(spark):
    assert one(spark, T.normalised(F.col("t")), t="  Ñandú, ÁÉÍ-e\u0301 12! ") == "nandu aei e 12"
    assert [one(spark, T.root(F.col("t")), t=t) for t in ("naciones", "canciones", "rapidamente", "casas", "gas")] == ["nacion", "cancion", "rapida", "casa", "gas"]
    assert [one(spark, T.number_core(F.col("t")), t=t) for t in ("82.000", "0,3", "007", "1.2.3", "5.", "1,50", "0")] == ["82000", "0.3", "7", "123", "5", "1.5", "0"]
    assert one(spark, T.shortened(F.col("t"), 10), t="one two three") == "one..."
    assert one(spark, T.json_object(F.col("t")), t="x {\"a\": [1,],} y") == "{\"a\": [1]}"
    assert one(spark, T.markers(F.col("t")), t="{{figura:a-1}} {{ figura : b }}") == ["a-1", "b"]


def test_panorama_of_the_known_case(spark):
    now = dt.datetime(2024, 3, 31)
    rows = [(1, now - dt.timedelta(days=2), 7000, 1), (2, now - dt.timedelta(days=3), 42000, 2), (3, now - dt.timedelta(days=45), 24500, 1)]
    sales = spark.createDataFrame(rows, "id long, ts timestamp_ntz, amount long, buyer long")
    point = lambda d: F.lit(now - dt.timedelta(days=d)).cast("timestamp_ntz")
    k = commerce.kpis(commerce.within(sales, point(30), point(0))).first()
    v = commerce.variation(sales, point(60), point(30), point(0)).first()
    r = commerce.repeat_buyers(sales, point(30), point(0)).first()
    assert (k.revenue, k.sales, k.buyers, v.previous, v.variation, r.repeat_share) == (49000, 2, 2, 24500, 100, 50)
    assert commerce.variation(sales.limit(0), point(60), point(30), point(0)).first().variation is None


def test_key_ledger_and_modes(spark):
    now = dt.datetime(2024, 3, 31)
    moves = spark.createDataFrame([(1, now - dt.timedelta(days=100), 98), (1, now - dt.timedelta(days=10), -40), (1, now - dt.timedelta(days=50), -40)], "owner int, ts timestamp_ntz, quantity long")
    r = commerce.consumption(moves, F.lit(now).cast("timestamp_ntz")).first()
    assert (r.weekly, r.balance, r.weeks_left) == (10.0, 18, 1.8)
    rows = spark.createDataFrame([(1, "b", 2, 2), (1, "a", 1, 1), (1, "a", 4, 4), (1, "b", 3, 3), (2, "z", 1, 1)], "k int, plan string, ts int, id int")
    assert {x.k: x.top_plan for x in commerce.most_frequent(rows, "k", "plan").collect()} == {1: "a", 2: "z"}


def test_unpaid_sales_by_buyer_and_plan(spark):
    shape = "buyer int, plan string, ts int, id int"
    unpaid = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 5, 2), (2, None, 5, 3), (3, "a", 5, 4)], shape)
    paid = spark.createDataFrame([(1, "a", 5, 9), (1, "c", 9, 8), (2, None, 6, 7), (3, "a", 4, 6)], shape)
    assert sorted((r.buyer, r.plan) for r in commerce.unpaid_without_later(unpaid, paid, "buyer", "plan").collect()) == [(1, "b"), (3, "a")]


def test_capacity_and_nearest_against_brute_force(spark):
    rng = random.Random(1)
    needs, sizes = [rng.randint(0, 400) for _ in range(300)], [rng.randint(0, 300) for _ in range(40)]
    found = relational.capacity(spark.createDataFrame([(i, float(n)) for i, n in enumerate(needs)] + [(999, None)], "i int, need double"), "need", spark.createDataFrame([(s,) for s in sizes], "size int"), "size", ranges=8)
    assert {r.i: r.fits for r in found.collect()} == {i: min((float(s) for s in sizes if s >= n), default=None) for i, n in enumerate(needs)} | {999: None}
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id < 7").selectExpr("vec_id AS query_id", "embedding AS asked")
    best = {(r.query_id, r.vec_id) for r in corpus.nearest(vectors, asked, 3, block=2).collect()}
    assert best == {(r.query_id, r.vec_id) for r in corpus.nearest(vectors, asked, 3).collect()} and len(best) == 21


def test_exam_rules(spark):
    rows = spark.createDataFrame([("completa", "evaluacion", 1), ("completa", "evaluacion", None), ("completa", None, 1), (None, None, None)], "kind string, mode string, course int")
    assert [r.x for r in rows.select(exams.final_exam().alias("x")).collect()] == [True, False, False, False]
    assert [one(spark, exams.selection(F.col("t")), t=t) for t in ("a", "B, a", "c;c / z", "", "a b")] == [["a"], ["a", "b"], ["c"], [], ["a", "b"]]
    options = F.create_map(F.lit("a"), F.lit("Red"), F.lit("b"), F.lit("Blue"))
    none = F.array().cast("array<string>")
    assert one(spark, exams.correct_letters(none, F.lit(" blue "), options), t=0) == ["b"]
    assert one(spark, exams.correct_letters(F.array(F.lit("B"), F.lit("z")), F.lit("a"), options), t=0) == ["b"]
    levels = spark.createDataFrame([(0,), (99,), (100,), (299,), (300,), (1000,)], "xp long")
    assert [(r.level, r.share) for r in levels.select(*(c.alias(k) for k, c in exams.level_range(F.col("xp")).items())).collect()] == [(1, 0), (1, 99), (1, 100), (1, 100), (2, 100), (4, 100)]
    shuffled = one(spark, exams.shuffled(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit("s")), t=0)
    assert sorted(shuffled) == ["x", "y", "z"] and shuffled == one(spark, exams.shuffled(F.array(F.lit("z"), F.lit("x"), F.lit("y")), F.lit("s")), t=0)


def test_selling_rules(spark, tmp_path):
    at = lambda *x: F.lit(dt.datetime(*x)).cast("timestamp_ntz")
    assert one(spark, selling.plus_months(at(2024, 1, 31, 5, 6), F.lit(1)), t=0) == dt.datetime(2024, 2, 29, 5, 6)
    assert [one(spark, selling.reminder(F.lit(d)), t=0) for d in (-1, 0, 1, 2, 3, 7, 8)] == [None, 1, 1, 3, 3, 7, None]
    assert one(spark, selling.dotted(F.lit(1234567)), t=0) == "1.234.567"
    rows = spark.createDataFrame([(1, 1, 3), (2, 2, None), (3, None, 3)], "id int, student int, school int")
    seen = lambda *a: sorted(r.id for r in selling.visible(rows, *a).collect())
    assert (seen("admin"), seen("student", 2), seen("director", None, 3), seen("guest"), seen("student")) == ([1, 2, 3], [2], [1, 3], [], [])
    second = selling.page(rows, "nonsense", {"id": [F.asc("id")]}, 2, 2).collect()
    assert [(r.id, r.total) for r in second] == [(3, 3)]
    selling.write_csv(rows.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("\ufeffid,student,school\n") and "2,2," in text
    batch = spark.createDataFrame([(1, "A@x.y"), (2, " a@x.y"), (3, "b@x.y"), (4, "bad")], "line int, mail string")
    key = F.lower(F.trim("mail"))
    status = selling.batch_status(batch, spark.createDataFrame([("b@x.y",)], "key string"), key, "line", key.contains("@"))
    assert {r.line: r.status for r in status.collect()} == {1: "new", 2: "repeated", 3: "exists", 4: "invalid"}


def test_marks_go_and_signs_are_no_words(spark):
    text = "# Title\n\n\n\n- a *bold* [link *one*](http://x) {{ figura: f-1 }}`code`\n  + b - c"
    row = spark.createDataFrame([(text,)], "t string").select(T.unmarkdown(F.col("t")).alias("plain"), T.markers(F.col("t")).alias("ids"), T.word_count(F.lit("a - b, niño 3.5 — x_y")).alias("n")).first()
    assert row.plain == "Title\na bold link one \nb - c" and row.ids == ["f-1"] and row.n == 7

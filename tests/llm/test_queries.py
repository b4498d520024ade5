"""The numbered queries on the smallest tables, against SQL where there is some and brute force otherwise."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest

from caudal.llm import decontamination, ngram_join, packing, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def frame(spark, texts, shape="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), shape)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLES[name])
    at = [d[0] for d in expected.description]
    names = sorted(found.columns)
    assert sorted(at) == names
    assert sorted(repr(tuple(r[c] for c in names)) for r in found.collect()) == sorted(repr(tuple(r[at.index(c)] for c in names)) for r in expected.fetchall())


def components(texts: dict) -> dict:
    sets, index, up = {}, defaultdict(list), {k: k for k in texts}
    for k, text in texts.items():
        w = WORD.findall((text or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in sets.items():
        hits = Counter(m for g in s for m in index[g])
        for m, n in hits.items():
            if 100 * n >= 80 * (len(s) + len(sets[m]) - n):
                a, b = top(k), top(m)
                up[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(k)
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_op1_against_brute_force(spark, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_join"](spark, SF).collect()}
    assert found == components({d["doc_id"]: d["text"] for d in documents})


def test_op1_defined_cases(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:58], "x", "y"]
    texts = [None, "", " \t", "one two", "One Two", " ".join(words), " ".join(near), " ".join(words), "one two three"]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark, frame(spark, texts)).collect()}
    assert found == components(dict(enumerate(texts)))
    assert ngram_join.linked(spark, frame(spark, [])).count() == 0


def test_op1_keeps_one_of_each_group_and_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, "other words", "c"), (3, "other words", "c"), (None, "no id", "d")], "doc_id long, text string, component_id string")
    kept = ngram_join.one_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3]


def distance(pattern: list, words: list) -> int:
    last = [0] * (len(words) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, w in enumerate(words, 1):
            now.append(min(last[j - 1] + (p != w), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


def test_op5_recall_at_the_greatest_distance(spark):
    import random

    rng = random.Random(4)
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    vocabulary = [w for d in items for w in split(d["text"])]
    texts, expected = [], set()
    for k in range(200):
        item = items[k % len(items)]
        words = split(item["text"])
        n = len(words)
        for _ in range(n * decontamination.SHARE // 100):
            p = rng.randrange(len(words))
            words[p : p + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        around = [rng.choice(vocabulary) + "q" for _ in range(60)]
        whole = [*around[:30], *words, *around[30:]]
        texts.append(" ".join(whole))
        if distance(split(item["text"]), whole) <= n * decontamination.SHARE // 100:
            expected.add((k, item["item_id"]))
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark, frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected) >= 190 and len(found & expected) >= 0.9 * len(expected)
    assert not found - expected


def test_op5_exact_copies_and_clean_documents(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y {item.upper()} z", 1), (2, "gamma delta only", 2), (3, None, 3), (4, "", 4)], "doc_id long, text string, item_id int")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontamination.leaks(spark, docs, bench).collect()] == [(1, 7, 0)]
    clean = decontamination.decontaminate(spark, docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert decontamination.leaks(spark, docs, bench.filter("false")).count() == 0


def test_op6_base_against_brute_force(spark, documents):
    found = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, SF).collect()}
    for d in documents:
        text, r = d["text"] or "", found[d["doc_id"]]
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else {}
        inside = {i + j for i in range(max(1, len(w) - 2)) for j in range(3) if w and grams[tuple(w[i : i + 3])] > 1}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_op6_filter_agrees_with_the_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(spark, docs, labels).filter("kept").collect()}
    passed = quality.passing(spark, docs, labels)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == kept


def test_op9_pieces_fill_sequences_without_gaps(spark, documents):
    rows = queries.QUERIES["op9_packing"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
    assert {r.doc_id: r.doc_tokens for r in rows} == dict(total) and set(total) == {d["doc_id"] for d in documents}


def test_op4_base_spans_by_plain_patterns(documents):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    count = lambda m: sum(c.isdigit() for c in m[0])
    extra = ["a@b.c", "x 1.2.3.4.5 999.1.1.1", "4111 1111 1111 1111", "+49 (0) 171-1234567", "", "@", "a@@b.c d@e"]
    for text in [d["text"] or "" for d in documents] + extra:
        plain = [("email", *m.span()) for m in email.finditer(text)]
        plain += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        plain += [("card", *m.span()) for m in card.finditer(text) if 14 <= count(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        plain += [("phone", *m.span()) for m in phone.finditer(text) if 10 <= count(m) <= 15]
        assert pii.base_spans(text) == sorted(plain, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_op7_scores_are_bounded_and_held_out(spark, documents):
    rows = queries.QUERIES["op7_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in rows} == {d["doc_id"] for d in documents}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.__doc__


def test_op2_and_op8_cover_every_page(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").num_rows
    texts = queries.QUERIES["op2_html_text"](spark, SF).collect()
    assert len(texts) == pages and all(r.n_chars == len(r.text) and "<nav" not in r.text for r in texts)
    verdicts = queries.QUERIES["op8_url_filter"](spark, SF).collect()
    assert len(verdicts) == pages and {r.verdict for r in verdicts} <= {"allow", "block"}


def test_pipeline_stages_take_effect(spark, documents):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert {k for k, (_, c) in components({r.doc_id: r.text for r in before.collect()}).items() if k == c} == {r.doc_id for r in docs.collect()}
        if name == "personal_data":
            assert not any(pii.base_spans(r.text or "") for r in docs.collect())
    assert len(documents) > sizes[0] > sizes[2] >= sizes[3] > 0
    assert len({hashlib.sha256(repr(s).encode()).hexdigest() for s in corpus_pipeline.STAGES}) == 5

"""Whitening, source divergence and the table of distinct words: against brute force, and on their defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from caudal.llm import divergence, queries, whitening, word_table

SF = "/root/testdata/sf0.001"


def whole(v):
    return [int(np.floor(1024 * float(c))) + 100000 for c in v]


def plain_whitening(rows):
    """n, deviations, eigenvalues, centred x in plain whole numbers and the library's own eigenvalues."""
    x = [whole(v) for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    real = np.array(y, float) / n
    values, vectors = np.linalg.eigh(real.T @ real / n)
    return n, [sum(a * a for a in v) for v in y], values[::-1], vectors[:, ::-1], real


def test_op11_against_brute_force(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    n, deviation, values, vectors, real = plain_whitening([r["embedding"] for r in rows])
    expected = np.abs(real @ vectors[:, :8] / np.sqrt(values[:8]))
    found = {(r.vec_id, r.component): r for r in queries.QUERIES["op11_whitening"](spark, SF).collect()}
    assert len(found) == 8 * n
    for i, r in enumerate(rows):
        for c in range(8):
            got = found[r["vec_id"], c + 1]
            assert (got.n, got.deviation) == (n, deviation[i]) and got.identity_error < 1e-10
            assert abs(abs(got.whitened) - expected[i, c]) < 1e-8 and abs(got.explained - values[c] / values.sum()) < 1e-9


def test_op11_small_eigenvalues_are_accurate_in_themselves():
    rng = np.random.default_rng(5)
    scale = np.logspace(0, -14, 9)
    base = np.eye(9) + 0.3 * np.diag(np.ones(8), 1) + 0.3 * np.diag(np.ones(8), -1)
    values, vectors = whitening.jacobi(scale[:, None] * base * scale)
    from fractions import Fraction

    exact = [[Fraction(a) for a in row] for row in (scale[:, None] * base * scale).tolist()]
    det = Fraction(1)
    for i in range(9):  # the determinant by exact elimination is the product of all eigenvalues
        det *= exact[i][i]
        for j in range(i + 1, 9):
            f = exact[j][i] / exact[i][i]
            exact[j] = [a - f * b for a, b in zip(exact[j], exact[i], strict=True)]
    assert abs(np.prod(values / scale**2) * float(np.prod(scale**2)) / float(det) - 1) < 1e-12 and values[-1] > 0
    assert np.abs(vectors.T @ vectors - np.eye(9)).max() < 1e-14
    a = rng.normal(size=(31, 31))
    values, vectors = whitening.jacobi(a + a.T)
    assert np.abs(vectors * values @ vectors.T - a - a.T).max() < 1e-12 and (np.diff(values) <= 0).all()
    assert whitening.jacobi(np.zeros((0, 0)))[0].shape == (0,)


def test_op11_defined_cases(spark):
    shape = "vec_id long, embedding array<float>, n int, whitened string"
    bad = [(1, None, 1, "a"), (2, [1.0, None, 2.0], 1, "b"), (3, [1.0, float("nan"), 2.0], 1, "c"), (4, [1.0, float("inf"), 0.0], 1, "d"), (5, [], 1, "e"), (6, [1.0, 2.0], 1, "f"), (7, [3e38, 0.0, 0.0], 1, "g")]
    good = [[0.5, 1.0, 3.0], [0.5, 2.0, -3.0], [0.5, 2.0, -3.0], [0.25, -7.5, 1e5]]
    docs = spark.createDataFrame(bad + [(None if i == 0 else 10, v, 1, "x") for i, v in enumerate(good)], shape)
    rows = whitening.report(spark, whitening.vectors_of(docs)).collect()
    n, deviation, values, _, _ = plain_whitening(good)
    assert Counter((r.vec_id, r.n, r.deviation) for r in rows) == Counter({(None, n, deviation[0]): 3, (10, n, deviation[1]): 6, (10, n, deviation[3]): 3})
    assert {r.component for r in rows} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in rows)
    flat = spark.createDataFrame([(1, [1.0, 4.0]), (2, [1.0, 5.0])], "vec_id long, embedding array<double>")
    assert {(r.component, abs(r.whitened), r.explained) for r in whitening.report(spark, flat).collect()} == {(1, 1.0, 1.0), (2, 0.0, 0.0)}
    one = whitening.report(spark, flat.filter("vec_id = 1")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(0.0, 0.0, 0.0, 0)] * 2
    far = spark.createDataFrame([(1, [2.0**41]), (2, [-(2.0**41)]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.report(spark, far).collect()] == [None, None, 0]
    assert whitening.report(spark, docs.limit(0).select("vec_id", "embedding")).collect() == []


TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_audit(docs, least=10, top=10):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        counts[lang, source].update(terms)
        seen[lang].update(terms.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        mine = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in mine:
            total.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in mine}, shares(total)
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, told in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(told, 1)}
    return out


def test_op12_against_brute_force_on_ties_nulls_and_groups_without_terms(spark):
    rng = random.Random(11)
    names = [f"{a}{b}" for a in ("é", "aa", "ÿz", "z") for b in ("", "x", "xy", "xyz", "中")]
    docs = [(" ".join(rng.choices(names, k=rng.randrange(30))) + rng.choice(["", ".", " 12 a|B", "\x00"]), rng.choice(["en", "de", None]), rng.choice(["s", "t", "ü", None])) for _ in range(300)]
    docs += [(None, "fr", "only"), ("", "en", "silent"), ("3 4 _", "de", "silent")] + [("aa aa", "es", s) for s in ("x", "y")] + [docs[0]] * 5
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, c int")
    for limit in (divergence.MAX_BROADCAST, 0):  # also with groups dealt in parts
        keep, divergence.MAX_BROADCAST = divergence.MAX_BROADCAST, limit
        try:
            assert set(map(tuple, divergence.audit(frame, least=5, k=3).collect())) == plain_audit(docs, 5, 3)
        finally:
            divergence.MAX_BROADCAST = keep
    assert divergence.audit(frame.limit(0)).collect() == []


def test_op12_radix_select_parts_ties_by_bytes(spark):
    rng = random.Random(2)
    rows = [(g, f"{'same' * 50}{i:04d}{'é' * (i % 3)}", rng.choice([0, 7, 1 << 40, (1 << 40) + 1])) for g in ("a", "b") for i in range(400)] + [("c", "lone", 5), ("d", "", 0), ("d", "\x00", 0), ("d", "b", 0)]
    frame = spark.createDataFrame(rows, "g string, item string, value long")
    found = {tuple(r) for r in divergence.leading(frame, ["g"], 2).select("g", "item", "value", "rank").collect()}
    expected = set()
    for g in "abcd":
        best = sorted((-v, i.encode()) for h, i, v in rows if h == g)[:2]
        expected |= {(g, i.decode(), -v, r) for r, (v, i) in enumerate(best, 1)}
    assert found == expected


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_op13_is_the_librarys_encoding_of_every_document(spark, tokenizer):
    found = {r.doc_id: r for r in queries.QUERIES["op13_bpe"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(found) == len(docs)
    for d in docs:
        ids = tokenizer[1].encode(d["text"] or "", add_special_tokens=False).ids
        text = tokenizer[1].decode(ids, skip_special_tokens=False)
        r = found[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op13_odd_texts_and_chunks(spark, tokenizer, monkeypatch):
    path, plain = tokenizer
    rng = random.Random(4)
    texts = ["don't 's 'sun x,'s it'll 'S", "<|endoftext|>", "a<|endoftext|>b <|EndOfText|> x<|y|>Z|Q", "H̱ T̈x Å. ≠a", "İstanbul ß ΣΣ ΑΣ.", "naïve,été—’s", "\x85 \x1c　a b", " \t\n", "", None, "1,000 12.5% a1b2", "中文 123² ½x", "x" * 5000 + "." + "É" * 3000]
    texts += ["".join(rng.choices("aB'.,-1 é̱́—²ZH<|>\t\n中", k=rng.randint(0, 60))) for _ in range(800)]
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(1, texts[0], "again", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, ids int").repartition(3)
    expected = Counter()
    for i, t, _, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        expected[i, tuple(ids), plain.decode(ids, skip_special_tokens=False)] += 1
    for chunk in (16 << 20, 2000):
        monkeypatch.setattr(word_table, "CHUNK", chunk)
        found = word_table.encode(spark, docs, path).collect()
        assert Counter((r.doc_id, tuple(r.ids), r.text) for r in found) == expected
    assert word_table.encode(spark, docs.limit(0), path).collect() == []
    told = spark.createDataFrame([("k", [320, 49407, 99999, -1]), (None, None), ("e", [])], "key string, ids array<int>")
    assert [(r.key, r.text) for r in word_table.decode(told, path).collect()] == [("k", "a</w> <|endoftext|>"), (None, ""), ("e", "")]


def test_op13_refuses_other_tokenizers_and_rows_in_changing_order(spark, tokenizer):
    import public_tokenizers
    from pyspark.errors import PythonException

    with pytest.raises(ValueError, match="word by word"):
        word_table.Splitter(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, f"w{i} of {i}") for i in range(40)], "doc_id long, text string")

    def mixed(batches):
        for batch in batches:
            yield batch.take(pa.array(random.SystemRandom().sample(range(batch.num_rows), batch.num_rows)))

    with pytest.raises(PythonException, match="another order"):
        word_table.encode(spark, docs.coalesce(1).mapInArrow(mixed, docs.schema), tokenizer[0]).collect()


def test_op13_codes_round_trip():
    codes = np.concatenate([np.arange(300), [1 << 14, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 31) - 1], np.zeros(3, np.int64)])
    assert word_table._unpacked(word_table._packed(codes)).tolist() == codes.tolist()
    assert word_table._unpacked(word_table._packed(codes[:0])).tolist() == []
    assert word_table.spoken(pa.array([[320], None, []], pa.list_(pa.int32())), pa.array([None] * 320 + ["a"])).to_pylist() == ["a", "", ""]

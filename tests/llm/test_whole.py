"""Cases in which an operator once did less than the whole job."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from caudal.llm import html_text, packing, pii, textkit, toxicity, url_filters

WORDS = "The river rose in the night and the town was woken by the bells."


@pytest.mark.parametrize(
    "html",
    [
        f'<html class="no-overlay"><body class="home no-sidebar"><div><p>{WORDS}</p></div></body></html>',
        f'<body id="search"><div class="content with-sidebar"><p>{WORDS}</p></div></body>',
        f'<body><article class="post paywall-content comment"><p>{WORDS}</p></article></body>',
        f'<body><main class="widget"><p>{WORDS}</p></main></body>',
        f'<body><div class="social-policy"><p>{WORDS}</p></div></body>',
        f'<body><div id="modal"><span class="alert"><article><p>{WORDS}</p></article></span></div></body>',
        f'<body><div class="overlay"><div role="main"><p>{WORDS}</p></div></div></body>',
        f'<body><div class="skip-list copyright-law related-work comment-theory alert-level search-tree"><p>{WORDS}</p></div></body>',
    ],
)
def test_op2_keeps_wrappers_of_content(html):
    assert html_text.Page(html).text() == WORDS


def test_op2_keeps_headings_and_math_and_drops_named_boxes():
    html = '<article><h2 id="search">Search</h2><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><div class="sidebar">A</div><div class="site-footer">B</div><div class="share_buttons">C</div></article>'
    assert html_text.Page(html).text() == "Search\n\nso x=2 holds"
    assert html_text.Page('<body><p>one</p><span class="ad">two</span>three<div class="cookie-banner">four</div></body>').text() == "one\n\nthree"


def test_op8_table_holds_no_site_of_the_pages_and_ordinary_names_pass(spark):
    names = {url.split("//")[1].split("/")[0] for url, _ in url_filters.training_urls()}
    words = {w for name in names for w in name.split(".")}
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["url"]).column(0).to_pylist()
    sites = {w for url in pages for w in url.split("//")[-1].split("/")[0].split(".")} - {"www", "m", "blog", "com", "net", "org", "example"}
    assert not words & sites
    held_out = ["free-software", "farmers-market", "plumbing"]
    assert not words & set(held_out)
    found = url_filters.judge(spark.createDataFrame([(i, f"https://{n}.com/en/77") for i, n in enumerate(held_out)], "page_id long, url string"), [], *url_filters.fit(url_filters.training_table(spark)))
    assert {r.host: r.verdict for r in found.collect()} == {f"{n}.com": "allow" for n in held_out}


def test_op9_ids_of_texts_with_added_tokens_are_those_of_the_plain_call():
    import public_tokenizers

    cache = packing.SpanCache(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["end <|endoftext|> next", "plain words, twice", "", "x<|startoftext|>y <|endoftext|>", "<|EndOfText|> z", "<|endoftext |>"]
    found = [x.tolist() for x in cache.encode(pa.array(texts))]
    assert found == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[0] == [806, 49407, 1131]


def test_op7_a_text_scores_the_same_alone_and_between_short_ones():
    rng = np.random.default_rng(1)
    model = toxicity.train([], np.zeros(0, bool))
    model.embedding[:], model.out[:] = rng.normal(0, 1, model.embedding.shape), 0.3
    tables = model.tables()

    def scores(texts):
        return np.concatenate([model.scores(*toxicity.word_buckets(data, offsets), tables) for _, _, data, offsets in textkit.parts(pa.array(texts))])

    model.intercept = -3.0
    texts = ["one", "clean and good words", "two", "", "it is", "so they went home again", "three", "four five", "a b c", "six"]
    assert np.allclose(scores(texts), [scores([t])[0] for t in texts], atol=1e-6)


def test_op4_finds_long_and_spoken_addresses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    addresses = [
        "maximilian.mustermannfrau @ mail.example.com",
        "annabelle.christophersen.longname @ department.university.example.org",
        "name [at] host.org",
        "john.smith (at) mail (dot) example (dot) com",
        "anna.berger at example dot com",
    ]
    texts = [f"they said that you may ask {a} for the rest of it" for a in addresses]
    found = [[t[a:b] for _, a, b in spans] for t, (_, spans) in zip(texts, pii.all_spans(texts, pii.fit(docs)), strict=True)]
    assert all(x in ([], [a]) for x, a in zip(found, addresses, strict=True)) and sum(map(len, found)) >= 4


def test_op4_windows_cover_spoken_signs_and_grow_with_the_span():
    class Names:
        def decode(self, ids):
            inside = (ids != pii.CLASS_OF[ord(" ")]) & (ids != pii.PAD)
            tags = np.where(inside, 2, 0)
            tags[:, 0] = inside[:, 0]
            tags[:, 1:][inside[:, 1:] & ~inside[:, :-1]] = 1
            return tags, np.ones(ids.shape)

    assert pii.windows("you may write name at host dot org, or name [at] host.org") and not pii.windows("we met at noon and the dot was red")
    name = "n" * 150 + "@" + "h" * 120
    assert ("email", 6, 6 + len(name)) in pii.tagged([f"words {name} words"], Names())[0]


@pytest.mark.parametrize("part", ["<div>x", "<b>", "<a", "<!", "<i></p>", "<main class=x>x", "<div class=sidebar>x<main>", "<td>x<th>", "<article><p>x</article>", '<a "><b \'>'])
def test_op2_reads_long_pages_in_one_pass(part):
    for html in (part * (1_000_000 // len(part)), "<th><table>" + "<b>" * 100_000 + part * (500_000 // len(part)) + ">"):
        start = time.process_time()
        page = html_text.Page(html)
        page.text({e[0] for e in page.elements[:9]})
        assert time.process_time() - start < 3


def test_op2_subtrees_are_equal_where_their_blocks_are():
    def hashes(html):
        page = html_text.Page(html)
        return {tuple(page.blocks[a:b]): h for h, _, a, b in page.elements}

    one, two = hashes("<div>a</div><div><p>b</p><p>c</p></div>"), hashes("<div>x y</div><p>b</p><div><p>b</p><p>c</p></div><div><p>c</p><p>b</p></div>")
    assert one[("b", "c")] == two[("b", "c")] != two[("c", "b")]
    assert len({*one.values(), *two.values()}) == len(one.keys() | two.keys())
    assert html_text.Page("<article>a</article><div>b</div>").elements == html_text.Page("<article>a</article>").elements  # what stands beside is not counted

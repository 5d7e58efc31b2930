import hashlib
import os
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest

from sylva.llm import bpe, decontaminate, html_text, language_id, quality
from sylva.llm.queries import vocabulary_path
from tests.llm.helpers import documents, sentence


# -- language ---------------------------------------------------------------------------------------------
def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 12, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    docs = documents(spark, rows, extra=True)
    model = language_id.train(docs.where("doc_id % 4 <> 0"), max_rows_per_language=1000)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [i for i, *_ in rows if i % 4 == 0]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    odd = documents(spark, [(1, None), (2, ""), (3, "12 %% \n"), (4, "und der die " * 60_000), (None, "the and thing"), (4, "le la les")])
    out = sorted(((r.doc_id or -1), r.lang_pred, r.score) for r in language_id.identify(odd, model).collect())
    assert [x[1] for x in out] == ["en", "und", "und", "und", "de", "fr"]
    assert all(0 <= x[2] <= 1 for x in out)
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_scores_match_a_plain_sum():
    texts = ["ab cd", "", "x" * 7, "The END é"]
    rng = np.random.default_rng(1)
    model = language_id.LanguageModel(("a", "b"), np.zeros(2), rng.random((1 << 8, 2)).astype(np.float32), 8, 3)
    want = np.zeros((4, 2))
    for i, t in enumerate(texts):
        c = language_id._codes(t)
        for n in (1, 2, 3):
            if len(c) >= n:
                want[i] += model.log_prob[language_id._hashes(c, n, 8)].sum(axis=0)
    assert np.allclose(model.scores(texts), want, atol=1e-4)
    old = language_id.PIECE
    try:
        language_id.PIECE = 4
        assert np.allclose(model.scores(texts), want, atol=1e-4)
    finally:
        language_id.PIECE = old


def plain_bayes(rows, texts, bits, max_n, smoothing):
    """Joint log-probabilities by dictionaries and Python integers."""
    import math

    def buckets(text):
        codes = [ord(c) if ord(c) >= 128 or "a" <= c <= "z" else 32 for c in text.lower()]
        for n in range(1, max_n + 1):
            for i in range(len(codes) - n + 1):
                h = n
                for k in range(n):
                    h = ((h ^ codes[i + k]) * int(language_id._MIX[k])) & 0xFFFFFFFF
                    h ^= h >> 15
                yield h >> (32 - bits)

    langs = sorted({k for _, k in rows})
    counts = {k: {} for k in langs}
    for text, k in rows:
        for b in buckets(text):
            counts[k][b] = counts[k].get(b, 0) + 1
    out = []
    for t in texts:
        own = list(buckets(t))
        out.append([math.log(sum(k == x for _, x in rows) / len(rows)) + sum(math.log((counts[k].get(b, 0) + smoothing) / (sum(counts[k].values()) + smoothing * 2**bits)) for b in own) for k in langs])
    return langs, out


def test_language_scores_match_plain_bayes(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 8, lang), lang) for i, lang in enumerate(["en", "de", "fr", "de"] * 6)]
    model = language_id.train(documents(spark, rows), bits=12, max_n=3)
    texts = [sentence(rng, 5, lang) for lang in ("en", "de", "fr")] + ["ß", "", "the und les", "x" * 300_000]
    langs, want = plain_bayes([r[1:] for r in rows], texts, 12, 3, 0.5)
    got = model.scores(texts)
    assert list(model.languages) == langs and np.allclose(got, want, rtol=1e-5, atol=1e-3)
    assert model.predict(texts[:3])[0] == [langs[int(np.argmax(w))] for w in want[:3]]


# -- pages --------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><p>Site name and a long slogan that is not part of the article at all</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this page, please accept them now.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b>\n text &lt;tag&gt;.<br>next line</p><p>Sh.</p><aside>Side note</aside>
<div class="ad">Buy now</div><p>Last &eacute;l&egrave;ve paragraph of the article, which is long enough.</p><form><p>Your name</p></form>
<section id="comments"><p>Reader comment that is quite long and should not be in the text.</p></section></article>
<div id="sidebar"><p>Related things to read</p></div><footer>&copy; site</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph with bold text <tag>. next line\n\nSh.\n\nLast élève paragraph of the article, which is long enough."


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("just  words\n here", "just words here"),
        ("<p>a<p>b<ul><li>c<li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<article><p><b>one<br><p>two", "one\n\ntwo"),
        ("<nav>menu</nav>", ""),
        ("<div><p>" + "long text " * 30 + "</p></div><div class='related'><p>" + "other " * 50 + "</p></div>", ("long text " * 30).strip()),
        ("<article><p>x</article", "x"),
        ("<main><p>text</p><script>if (a < b) { document.write('<p>no</p>') }</script></main>", "text"),
        ("&amp &am &#233; &bogus;", "& &am é &bogus;"),
    ],
)
def test_main_text_edges(html, want):
    assert html_text.main_text(html) == want


LONG = "A sentence of the story with quite a few words in it, and more. " * 5


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<body><h1>Title</h1><div class=post><p>{LONG}</p></div></body>", ["Title", LONG]),
        (f"<body><h1>Title</h1><nav>menu</nav><nav>menu</nav><nav>menu</nav><p>By me</p><nav>menu</nav><nav>menu</nav><nav>menu</nav><div><p>{LONG}</p></div></body>", ["Title", "By me", LONG]),
        (f"<body><div><p>Short intro.</p></div><div class=post><p>{LONG}</p><p>{LONG}</p></div></body>", ["Short intro.", LONG, LONG]),
        (f"<main><article><p>{LONG}one</p></article><article><p>{LONG}</p></article></main>", [LONG + "one", LONG]),
        (f"<main><article><p>{LONG}one</p></article><section><p>{LONG}</p></section></main>", [LONG + "one", LONG]),
        (f"<body><article><p>{LONG}one</p></article><div><p>{LONG}</p></div></body>", [LONG + "one", LONG]),
        (f"<body><a name=top><h1>Title</h1><div><p>{LONG}</p></div><div><a href=/x><p>{LONG}two</p></a></div></body>", ["Title", LONG, LONG + "two"]),
        ("<body>" + "<ul><li><a href=/>Home</a></li></ul>" * 5 + f"<div><p>{LONG}</p><p><a href=/s>Source</a></p></div></body>", [LONG, "Source"]),
    ],
)
def test_main_text_drops_no_block_but_boilerplate(html, want):
    assert html_text.main_blocks(html) == [x.strip() for x in want]


SIDE = "".join(f"<div>{w}</div>" for w in ("Weather", "Oslo 12", "Polls", "Top rated"))
LINKS = "<div><div>See also</div>" + "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(6)) + "</div>"


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<body>{LINKS}<div><h1>Title</h1><p>{LONG}</p><div>Short.</div><div>Oslo</div></div></body>", ["Title", LONG, "Short.", "Oslo"]),
        (f"<body><div>{SIDE}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>", [LONG, LONG]),
        (f"<body><div><p>{LONG}</p></div><div>{SIDE}</div>{LINKS}</body>", [LONG]),
    ],
)
def test_clusters_select_regions_without_marks(html, want, monkeypatch):
    assert html_text.main_blocks(html) == [x.strip() for x in want]
    monkeypatch.setattr(html_text, "smoothed_ratios", lambda lines: [1.0] * len(lines))
    monkeypatch.setattr(html_text, "THRESHOLD", 0.0)
    assert html_text.main_blocks(html) != [x.strip() for x in want]  # without ratios nothing is told apart


def plain_blocks(html):
    """Another way to the text of pages whose boilerplate is all in elements of its own: regular expressions on whole elements."""
    html = re.sub(r"(?s)<!--.*?-->|<(script|style|title|nav|footer)\b.*?</\1>|<div class=.ad.>.*?</div>", "", html)
    blocks = re.split(r"</?(?:html|head|body|article|p|h1|ul|li|div|meta|!DOCTYPE)\b[^>]*>", html)
    texts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|a)\b[^>]*>", "", b)))).strip() for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_pages_match_another_way():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    pages = pq.read_table(path).to_pylist()
    assert pages and all(html_text.main_text(r["html"]) == plain_blocks(r["html"] or "") for r in pages)


def test_deep_and_cut_off_pages():
    deep = "<div><b>" * 60_000 + LONG + "<p>x</i>" * 20_000
    began = time.process_time()
    blocks = html_text.main_blocks(deep)
    assert time.process_time() - began < 20 and blocks[0] == LONG.strip() and blocks.count("x") == 20_000
    assert html_text.main_text("<p>a</p><!-- c > d") == "a"
    assert html_text.main_text("<p>a < b</p>c < d") == "a < b\n\nc < d"
    assert html_text.main_text("<p>a</p><a href='x > y") == "a"


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "w", "<p>z</p>" * 3000, "z")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert out[2].text == "" and out[2].n_chars == 0 and out[1].n_chars == len(out[1].text)
    assert out[None].text == "\n\n".join(["z"] * 3000)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_smoothing_weighs_neighbours():
    s = html_text.smoothed_ratios([("a" * 100, 1), ("b", 1), ("c" * 100, 1)])
    assert s[1] > 30 and s[0] < 100


# -- benchmark ----------------------------------------------------------------------------------------------
def brute_hits(text, items, size=13):
    words = decontaminate.words_of((text or "").encode())
    hit, ids = set(), set()
    for item, body in items:
        w = decontaminate.words_of((body or "").encode())
        for win in [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []:
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids.update([] if item is None else [str(item)])
    return len(words), len(hit), sorted(ids)


def contaminated_corpus():
    rng = random.Random(2)
    items = [(k, sentence(rng, rng.choice([1, 2, 5, 13, 14, 30]))) for k in range(30)] + [(30, None), (31, ""), (None, "the and thing with"), (3, "second text of item three")]
    docs = []
    for k in range(60):
        parts = [sentence(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items[:30])[1].split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[a : a + rng.choice([12, 13, 20, 40])]).upper().replace(" ", rng.choice([" ", ", ", "\n"])), sentence(rng, rng.randint(0, 10))]
        docs.append((k, ". ".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, docs[1][1]), (104, "x" * 300_000)]
    return docs, items


def test_decontamination_matches_brute_force(spark, monkeypatch):
    docs, items = contaminated_corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    for limit, chain in ((decontaminate.BLOCK_BYTES, 16), (200, 2)):  # one block, and many with few in a job
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontaminate, "CHAIN", chain)
        out = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, docs, extra=True), table).collect()}
        for k, text in docs:
            n, hit, ids = brute_hits(text, items)
            r = out[k]
            assert (r.n_words, r.n_hit, list(r.item_ids), r.n_items) == (n, hit, ids, len(ids)), k
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert sum(r.contaminated for r in out.values()) > 10


def test_decontamination_of_empty_tables(spark):
    docs = documents(spark, [(1, "some text here"), (None, "more")])
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    out = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(out) == 2 and not any(r.contaminated for r in out)
    assert decontaminate.items_digest([]) == hashlib.sha256(b"").hexdigest()


# -- tokens -------------------------------------------------------------------------------------------------
def odd_texts():
    rng = random.Random(7)
    pool = "abc'st <|>́éÅΑΣß1٣\n \x1f中😀."
    fixed = ["", " ", "\x1c a\x1db", "İstanbul ΑΣ ς Σ", "é I'LL don't'S", "<|endoftext|>abc <|startoftext|>", "a" * 3000, "ab" * 500 + "!" * 200, "x　y", "</w> <w>", "हिन्दी", "\x00\x01 \x7f", "thThéé" * 50]
    return fixed + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_bpe_matches_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary_path())
    own = bpe.ForcedBpe(bpe.read_spec(vocabulary_path()))
    for t in odd_texts():
        want = reference.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == reference.decode(want, skip_special_tokens=False) == own.texts(t)[1]


def test_forced_boundaries_cut_nothing_that_merges():
    own = bpe.ForcedBpe(bpe.read_spec(vocabulary_path()))
    cut = own.fragments("qxzjvkw")
    assert "".join(cut) == "qxzjvkw" and len(cut) > 1
    for a, b in zip(cut, cut[1:]):
        assert not any(a[-1] + b[0] in t.removesuffix("</w>") for t in own.vocab)


def test_bpe_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 3)
    docs = documents(spark, [(1, "Hello there, hello"), (2, None), (3, "  "), (1, "Hello there, hello"), (None, "x")], extra=True)
    out = bpe.encode(docs, vocabulary_path()).collect()
    assert len(out) == 5
    for r in out:
        assert r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), vocabulary_path()).count() == 0


# -- quality ------------------------------------------------------------------------------------------------
def test_quality_ranks_held_out_documents(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        text = sentence(rng, rng.randint(20, 80))
        if k % 4 == 0:
            text = " ".join(w + rng.choice(["%%%", "***"]) for w in text.split()) if k % 8 else text.upper() + "!!"
        rows.append((k, text))
        labels.append((k, int(k % 4 != 0), 0))
    docs, marks = documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks.where("doc_id % 3 <> 0"))
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [k for k in range(240) if k % 3 == 0]
    assert sum(out[k].predicted == int(k % 4 != 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())


def test_quality_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a b " * 400_000), (None, "x"), (1, None)])
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score(docs, none).collect()
    assert len(got) == 5 and all(r.predicted == 1 and abs(r.score - quality.CUT) < 1e-9 for r in got)
    assert quality.score(docs.limit(0), none).count() == 0
    x = quality.features([b"", b"Ab ab AB\nab"])
    assert x.shape == (2, quality.N_FEATURES) and np.isfinite(x).all()


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) > -1).astype(int)
    model = quality.fit(x, y)
    s = model.score(x)
    assert s[y == 1].mean() > s[y == 0].mean() + 0.3 and ((s >= 0.7) == y).mean() > 0.95


def test_quality_fit_is_the_minimum_of_the_pair_loss():
    """Against the loss written out pair by pair, and scores written out document by document."""
    import math

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=60) > 0.3).astype(int)
    model = quality.fit(x, y, pairs=500, ridge=3.0, seed=11)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = [[min(5.0, max(-5.0, (v - m) / s)) for v, m, s in zip(row, mean, scale)] for row in x.tolist()]
    draw = np.random.default_rng(11)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), 500), draw.choice(np.flatnonzero(y == 0), 500)))

    def loss(w):
        apart = (sum(wi * (a - b) for wi, a, b in zip(w, z[i], z[j])) for i, j in pairs)
        return sum(math.log1p(math.exp(-d)) for d in apart) + 1.5 * sum(v * v for v in w)

    best = model.weight.tolist()
    for k in range(4):
        for step in (-1e-3, 1e-3):
            assert loss([v + step * (i == k) for i, v in enumerate(best)]) > loss(best)
    raw = [sum(a * b for a, b in zip(best, row)) for row in z]
    assert sum(r < model.cut for r in raw) == (y == 0).sum()
    for r, s in zip(raw, model.score(x)):
        assert abs(s - 1 / (1 + math.exp(-(r - model.cut) / model.spread) * (0.3 / 0.7))) < 1e-6 and (s >= 0.7) == (r >= model.cut)


def test_crc_of_ids(spark):
    from sylva.llm.common import crc32_of_id

    df = spark.createDataFrame([(5,), (None,)], "doc_id long").select(crc32_of_id("doc_id").alias("c"))
    assert [r.c for r in df.collect()] == [zlib.crc32(b"5"), None]

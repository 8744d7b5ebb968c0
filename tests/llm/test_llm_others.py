"""Pages, vectors, components and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from pagelattice.llm import components, embed_dedup, entry, html_text


def test_html():
    words = "some words of the article that go on and on "
    page = (
        "<!doctype html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site name</h1></header><nav><a href=/>Home</a> <a href=/x>News</a></nav>"
        "<div class='cookie-notice'>We use cookies for many things that you may or may not like, please accept all of them now.</div>"
        f"<article><h1>Title &amp; more</h1><p><b>{words * 3}<br><p>Short.</p>"
        f"<ul><li><a href=1>Link</a></li></ul><p>{words}&nbsp; x&#x27;s</p>"
        f"<section id=comments><p>{words * 4}</p></section></article>"
        f"<aside><p>{words * 5}</p></aside><form>Your mail</form><footer>&copy; someone</footer>"
    )
    want = ["Title & more", (words * 3).strip(), "Short.", "Link", f"{words}x's"]
    assert html_text.main_text(page).split("\n") == want
    plain = f"<div><a>Home</a></div><div id=content><h2>Heading</h2><p>{words * 6}</p><p>Brief.</p><p>{words * 5}</p></div><div class='sidebar'>{words * 9}</div>"
    assert html_text.main_text(plain).split("\n") == ["Heading", (words * 6).strip(), "Brief.", (words * 5).strip()]
    for odd in ("", "<", "<p", "a < b", "<p title='x>y", "</p></div>", "<!-- x", "<script>", "&#xD800;<b>"):
        assert isinstance(html_text.main_text(odd), str)


def test_tree_fits_its_table():
    table = np.array(html_text.LABELLED, float)
    assert all(html_text.is_main(html_text.tree(), tuple(r[:-1])) == bool(r[-1]) for r in table)


def test_place_decides_in_articles_and_boilerplate():
    rng = np.random.default_rng(0)
    for _ in range(500):
        words, densities = rng.integers(1, 300, 3), rng.random(3) * (rng.random(3) < 0.5)
        row = [x for pair in zip(words, densities, strict=True) for x in pair]
        for place in (html_text.MAIN, html_text.BOILERPLATE, html_text.COMMENTS):
            assert html_text.is_main(html_text.tree(), (*row, place, 0)) == (place == html_text.MAIN)


ARTICLE = "<p>" + "words that make up the article and go on for a while " * 3 + "</p>"
KEPT = ("words that make up the article and go on for a while " * 3).strip()
AWAY = "<p>" + "other words that fill a box and are not what the page is about " * 3 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="single no-sidebar"><nav>{AWAY}</nav><article>{ARTICLE}</article></body>',
        f'<body class="comments-open sidebar"><div>{ARTICLE}</div></body>',
        f'<main class="has-sidebar">{ARTICLE}</main>',
        f'<article class="post tags-legal">{ARTICLE}</article>',
        f'<article class="post category-privacy">{ARTICLE}</article>',
        f'<article id="form-follows-function">{ARTICLE}</article>',
        f"<html><head><title>Title</title><meta name=x><body><article>{ARTICLE}</article>",
        f"<html><head><title>Title</title><link rel=y><article>{ARTICLE}</article>",
        f'<article>{ARTICLE[:-4]}<p class="advert">buy this now at once</p></article>',
        f'<article>{ARTICLE}<ul><li class="cookie-notice">{AWAY}</li></ul></article>',
        f'<article>{ARTICLE}</article><aside class="related"><article>{AWAY}</article></aside>',
        f'<article>{ARTICLE}</article><div class="sidebar"><div class="post">{AWAY}</div></div>',
        f'<article><svg width="1" title="a>b"/>{ARTICLE}<svg><text>no</text></svg></article>',
        f'<div class="no-comments"><article>{ARTICLE}</article><div id="comment-list">{AWAY}</div></div>',
        f'<div class="siteFooter">{AWAY}</div><main><header>{ARTICLE}</header></main><header>{AWAY}</header>',
        f'<article>{ARTICLE}<section class="newsletter-signup">{AWAY}<div>{AWAY}</div></section></article>',
        f"<article><select><option>x</select><button>go</button>{ARTICLE}</article>",
        *[
            f'<article>{ARTICLE}<div class="{name}">{AWAY}</div></article>'
            for name in (
                "google-ads", "adsbygoogle", "ad-300x250", "user-comments", "fb-comments", "post-comments-area", "newsletter-cta", "email-signup",
                "subscribe-now", "share-buttons", "sharedaddy", "related-reading", "td-related-title", "cookie-law-info", "outbrain",
            )
        ],
        *[f'<div class="{name}"><article>{ARTICLE}</article></div>' for name in ("content-sidebar-wrap", "layout-with-sidebar", "category-social", "hide-comments")],
        f"<ul><li class=menu-item>{AWAY}<li class=nav>{AWAY}</ul><article>{ARTICLE}</article>",
    ],
)
def test_places(page):
    assert html_text.main_text(page) == KEPT


def test_words_and_links_decide_where_elements_tell_nothing():
    """On pages of plain div elements no block has a place, and without words and densities the result is another."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 999, n))
    right = changed = 0
    for _ in range(60):
        blocks, want = [], []
        for _ in range(int(rng.integers(2, 9))):  # a menu
            blocks.append(f"<div><a href=x>{words(2)}</a></div>")
        for _ in range(int(rng.integers(2, 7))):
            want.append(words(int(rng.integers(30, 160))))
            blocks.append(f"<div>{want[-1]}</div>")
        for _ in range(int(rng.integers(2, 6))):
            blocks.append(f"<div><a href=y>{words(3)}</a></div>")
        page = "".join(blocks)
        assert all(b.place == html_text.NEUTRAL for b in html_text.blocks(page))
        right += html_text.main_text(page).split("\n") == want
        found = html_text.blocks(page)
        plain = [html_text.is_main(html_text.tree(), (0, 0.0, 0, 0.0, 0, 0.0, b.place, b.heading)) for b in found]
        changed += [b.text for b, p in zip(found, plain, strict=True) if p] != want
    assert right >= 57 and changed == 60


def test_short_text_stays_on_pages_without_places():
    page = "<div><table><tr><td>Height</td><td>12 m</td></tr><tr><td>Built</td><td>1900</td></tr></table><p>It is old.</p><p>It still stands today.</p></div>"
    assert html_text.main_text(page) == "Height\n12 m\nBuilt\n1900\nIt is old.\nIt still stands today."
    linked = "<div><a href=x>Home</a></div><div><a href=y>News</a></div>"
    assert html_text.main_text(linked) == ""


def test_long_page():
    import time

    page = "<div>" * 3000 + "<nav>" + "<a href=x>go</a> " * 20_000 + "</nav><article>" + ARTICLE * 8000 + "</article>"
    began = time.process_time()
    assert html_text.main_text(page) == "\n".join([KEPT] * 8000)
    assert time.process_time() - began < 10


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>", 1), (None, None, None, 2), (1, "u", "", 3)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract_pages(rows).collect()), key=str)
    assert got == sorted([(1, "u", "x y", 3), (None, None, "", 0), (1, "u", "", 0)], key=str)
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def brute_links(ids, vectors, threshold=0.9):
    def valid(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(ids)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and ids[i] is not None and ids[j] is not None and valid(a) and valid(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                near[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold
    label = list(range(n))
    for _ in range(n):
        for i, j in zip(*np.nonzero(near), strict=True):
            label[i] = min(label[i], label[j])
    least = {k: min((ids[i] for i in range(n) if label[i] == k and ids[i] is not None), default=None) for k in set(label)}
    return [(ids[i], int(near[i].sum()), least[label[i]], ids[i] is not None and ids[i] == least[label[i]]) for i in range(n)]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    vectors = [(centres[k % 12] + rng.normal(size=8) * 0.25).astype(np.float32).tolist() for k in range(150)]
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], vectors[3]]
    ids = [*rng.permutation(len(vectors) - 1).tolist(), None]
    ids[5] = ids[6]  # a repeated id
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, part string, links int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.link_vectors(rows).collect()]
    assert sorted(got, key=str) == sorted(brute_links(ids, vectors), key=str)
    assert embed_dedup.link_vectors(rows.limit(0)).count() == 0


@pytest.mark.parametrize("dimension", [3, 64, 1500])
def test_bound_holds(dimension):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, dimension)) * rng.lognormal(size=(200, dimension))
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, dimension)) * 0.3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embed_dedup.Quantised(x)
    assert q.codes.dtype == np.int8
    every = slice(None)
    assert (q.products(every, q, every) == q.codes.astype(np.int64) @ q.codes.astype(np.int64).T).all()
    cosines = x @ x.T
    for threshold in (-0.2, 0.3, 0.9, 0.999):
        possible = q.possible(every, q, every, threshold)
        assert possible[cosines >= threshold].all()
        if dimension > 3:
            assert possible.sum() < (cosines >= threshold - 0.12).sum() + 1  # and little else is computed in full


@pytest.mark.parametrize("dimension", [1, 2, 3, 64, 1500, 2200])
def test_heads_bound_cosines(dimension):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, dimension)) * rng.lognormal(size=(200, dimension))
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, dimension)) * 0.3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    heads, every = embed_dedup.Heads(x), slice(None)
    for threshold in (-0.2, 0.3, 0.9, 0.999):
        assert heads.possible(every, heads, every, threshold)[x @ x.T >= threshold].all()


@pytest.mark.parametrize("halves", [(1, 1), (1, 0.02), (0.02, 1)])
def test_half_of_the_dimensions_part_most_vectors(monkeypatch, halves):
    """Whole codes are compared only where heads leave many pairs; the pairs are all those of brute force."""
    tiles, products = [], embed_dedup.Quantised.products
    monkeypatch.setattr(embed_dedup.Quantised, "products", lambda *a: tiles.append(1) or products(*a))
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 64)) * np.repeat(halves, 32)
    x[700:1000] = x[:300] + rng.normal(size=(300, 64)) * np.linspace(0, 0.6, 300)[:, None] * np.repeat(halves, 32)
    y = x[600:] * rng.lognormal(size=(900, 1))
    for other in (None, y):
        found = [p for i, j in embed_dedup.near_pairs(x, other, 0.9) for p in zip(i.tolist(), j.tolist(), strict=True)]
        z = x if other is None else other
        near = (x @ z.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(z, axis=1)) >= 0.9
        assert sorted(found) == sorted(zip(*np.nonzero(np.triu(near, 1) if other is None else near), strict=True))
        assert len(found) > 100
    assert bool(tiles) == (halves == (0.02, 1))


def test_small_groups(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "GROUP", 16)
    rng = np.random.default_rng(8)
    vectors = [v.astype(np.float32).tolist() for v in np.repeat(rng.normal(size=(10, 6)), 9, 0) + rng.normal(size=(90, 6)) * 0.2]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.link_vectors(rows).collect()]
    assert sorted(got) == sorted(brute_links(list(range(90)), vectors))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, 4)]
    found = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 140), 100)
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
    label = components.merged(np.arange(6), np.array([5, 4]), np.array([4, 2]))
    assert label.tolist() == [0, 1, 2, 3, 2, 2]


def test_entry_names():
    assert {int(n[2:].split("_")[0]) for n in entry.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "repeats", "packing"]


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [f"term{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(" ".join(rng.choice(words, 12)) + "." for _ in range(6))
        toxic = i % 6 == 0
        rows.append((i, text + (" you zorgul creature. such a zorgul mind." if toxic else ""), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    shared, own, other = (" ".join(rng.choice(words, n)) for n in (60, 40, 40))
    rows += [(300, rows[1][1], "en", "s", None), (301, f"start {own} {shared} ending", "en", "s", None), (302, f"{other} {shared}", None, None, None), (303, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/stage{k}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(seen["toxicity"]) == {i for i in (*range(240), *range(300, 304)) if i >= 240 or i % 6}
    assert ids(seen["simhash"]) == ids(seen["toxicity"]) - {300}
    texts = {r.doc_id: r.text for r in seen["repeats"].collect()}
    # the sixty words that both share go, with the space before them, and their own words stay
    assert texts[301].startswith("start term") and len(texts[301].split()) == 42 and len(texts[302].split()) == 40 and texts[303] is None
    assert all(len(t) > 300 for i, t in texts.items() if i < 240)
    assert ids(seen["packing"]) == set(texts)
    rows = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sum(r[2] for r in rows) == sum(r.length for r in seen["packing"].collect())

from pyspark.sql import functions as F

from pagelattice.operators import report
from pagelattice.sources import cache, events, html, model_answers, pairs, sinks
from pagelattice.streaming import runs


def test_pairs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('source,target\n"https://a","https://b,c"\n,x\nnocomma\n\n s , t \n')
    found = pairs.read(spark, str(tmp_path / "a.csv")).orderBy("idx").collect()
    assert [(r.source_url, r.target_url) for r in found] == [("https://a", "https://b,c"), ("s", "t")]
    (tmp_path / "b.csv").write_text("﻿source-url,target-url\r\nx,y\r\n")
    assert pairs.read(spark, str(tmp_path / "b.csv")).count() == 2


def test_json(spark):
    texts = ['```json\n{"a":1}\n```', 'x {"a":1} y', "none", "{no}", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(model_answers.json_object(F.col("t")))
    assert [r[0] for r in found.collect()] == ['{"a":1}', '{"a":1}', None, None, None]


def test_ask(spark):
    def call(prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    rows = spark.createDataFrame([("1", "hi"), ("2", "bad")], "key string, prompt string")
    assert {tuple(r) for r in model_answers.ask(rows, call).collect()} == {("1", "HI"), ("2", None)}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    answers = spark.createDataFrame([("ab1", "x"), ("ab1", "x"), ("cd2", None)], "key string, value string")
    cache.write(answers, path)
    asked = spark.createDataFrame([("ab1",), ("cd2",), ("cd2",)], "key string")
    assert [r.key for r in cache.misses(asked, cache.read(spark, path)).collect()] == ["cd2"]
    s = cache.stats(asked, cache.read(spark, path)).first()
    assert (s.requests, s.hits, s.misses, s.hit_percent) == (3, 1, 2, 33.3)


def test_html(spark):
    page = "<html><head><title> A  b</title></head><body><script>p='<p>no</p>'</script><main><div data-block-name=hero><h1>Big</h1><p>one<br>two</div><div class='block x'>z</div></main><p>Big</p><li>t&amp;u"
    read = html.read_page(page)
    assert read.lines == ["Big", "one", "two", "t&u"]
    assert (read.is_eds, read.sections, [b["name"] for b in read.blocks], read.title) == (True, 2, ["hero", "x"], "A b")
    rows = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert html.page_lines(rows).count() == 4
    assert {(r.page_id, r.title) for r in html.titles(rows).collect()} == {(1, "A b"), (2, None)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "pass", True, 0.5, None, 1.0, "a,b", 'q"')], "slug string, verdict string, skipAi boolean, imageSimilarity double, textRecall double, heightRatio double, sourceUrl string, targetUrl string")
    sinks.write_csv(rows.coalesce(1), "screening-summary", str(tmp_path))
    text = "".join(p.read_text() for p in (tmp_path / "screening-summary").glob("part*"))
    assert text == 'slug,verdict,skipAi,imageSimilarity,textRecall,heightRatio,sourceUrl,targetUrl\ns,pass,1,0.5,,1.0,"a,b","q"""\n'
    summary = sinks.run_summary(spark.createDataFrame([(1, "b"), (0, "a")], "idx int, slug string"), {"run": "r"}).first().json
    assert summary == '{"run":"r","results":[{"idx":0,"slug":"a"},{"idx":1,"slug":"b"}]}'
    nodes = spark.createDataFrame([("p", 0, "text", "<b>", None, None, 1, 2, 3, 4, 16, "red"), ("p", 1, "image", None, "x.png", "img", 0, 0, 9, 9, None, None)], "page_id string, ord int, kind string, text string, src string, tag string, x int, y int, w int, h int, font_size int, color string")
    page = sinks.page_html(nodes).first().html
    assert page.index("x.png") < page.index("&lt;b&gt;")
    assert "<rect" in sinks.overlay_svg(nodes.withColumn("pair_id", F.lit("p")), "green").first().svg


def test_events(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01 00:00:00' + make_dt_interval(0,0,0,n) as ts, 's' as slug, 'e' as event, repeat('x', 9000) as data from values (0),(30),(60),(61) t(n)")
    events.write(rows, str(tmp_path / "log"))
    back = events.read(spark, str(tmp_path / "log"))
    assert back.agg(F.max(F.length("data"))).first()[0] < 8100
    assert [r.in_window for r in events.in_last_minute(back, "slug").orderBy("ts").collect()] == [1, 2, 3, 3]
    q = runs.by_minute(runs.event_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("by_minute").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from by_minute").collect()) == [2, 2]


def test_priority(spark):
    rows = spark.createDataFrame([(1, i, t, u, loc, None) for i, (t, u, loc) in enumerate([("modal", "low", "top"), ("cookie-banner", "medium", "center")])], "page_id int, ord int, type string, urgency string, location string, bounds string")
    assert [(r.ord, r.priority) for r in report.first_overlays(rows, 1).collect()] == [(1, 155)]


def test_lines_of_all_wanted_elements():
    """Text of div and span elements too, outer elements first, each line once; long texts are not taken, their parts are."""
    page = "<div>plain div text</div><span>span text</span><p>para</p><dl><dt>term</dt><dd><b>not wanted</b></dd></dl>"
    assert html.read_page(page).lines == ["plain div text", "span text", "para"]
    nested = "<div>outer <a>link</a><div>inner<br>second</div></div><div>inner</div><div>x</div>"
    assert html.read_page(nested).lines == ["outer link", "inner", "second", "link"]
    long = "<div>" + "<p>" + "w " * 3999 + "</p><p>short one</p></div>"
    assert html.read_page(long).lines == [("w " * 3999).strip(), "short one"]
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert html.read_page(deep).lines == ["deep"]


def test_void_children_of_main_are_sections():
    r = html.read_page("<main><hr><div class='block hero'>one<br>two</div><img src=x><section><p>a</p></section></main>")
    assert (r.sections, [b["name"] for b in r.blocks], [b["lines"] for b in r.blocks]) == (4, ["hero"], [2])


def test_lengths_are_those_of_the_shown_text():
    spaced = "<div>" + "\n        ".join(f"<b>w{i}</b>" for i in range(900)) + "</div>"
    assert len(spaced) > 8000 and html.read_page(spaced).lines == [" ".join(f"w{i}" for i in range(900))]
    for n in (7999, 8000):
        found = html.read_page("<div>   " + "x" * 5 + " \n " + "y" * (n - 6) + "  \t</div>").lines
        assert len(found) == (n < 8000), n


def test_hidden_elements_and_descriptions():
    page = "<body><p hidden>one</p><div style='color:red; display: none'>two <p>three</p></div><p style='visibility:hidden'>four</p><p style='opacity:0.01'>five <span>six</span></p>"
    read = html.read_page(page + "<div>seven<p style='display:none'>eight</p></div><img alt=' a  cat '><img hidden alt='dog'><img alt='x'></body>")
    assert read.lines == ["six", "seven"]
    assert read.all_lines(True) == ["six", "seven", "a cat"]


def test_only_the_first_main_is_read():
    read = html.read_page("<main><p>a</p><main><div class='block in'>x</div></main></main><main><section></section><div data-block-name='late'>y</div></main>")
    assert (read.sections, [b["name"] for b in read.blocks], read.is_eds) == (2, ["in"], False)


def test_words_of_a_line_are_shuffled_as_plain_lists(spark):
    """Words come in any order, those without a place first; no list of structs is shuffled, which took more bytes."""
    from pagelattice.sources import ocr

    rows = [("i", 0, 5, 0, 0, 0, o, left, 10, 5, 5, 90.0, t) for o, left, t in ((2, 20, "three"), (1, 10, "two"), (None, 0, "one"))]
    words = spark.createDataFrame(rows, "image_id string, tile_top int, level int, block_num int, par_num int, line_num int, ord int, left int, top int, width int, height int, conf double, text string")
    found = ocr.lines(words.repartition(3))
    assert [(r.text, r.x, r.y, r.w, r.h) for r in found.collect()] == [("one two three", 0, 10, 25, 5)]
    assert "collect_list(struct" not in found._jdf.queryExecution().optimizedPlan().toString()

from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.operators import audit, content, recipe, screening


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_normalisers(spark):
    assert column(spark, ["  Hello  World​ ", None], text.line) == ["hello world", ""]
    assert column(spark, ["été à Paris!", "60X → 40X", "日本語"], text.key) == ["t paris", "60x 40x", ""]
    lines = spark.range(1).select(text.visible_lines(F.array(*map(F.lit, ["Home", " home ", "HOME!", "x", "We use cookies here"]))))
    assert lines.first()[0] == ["home", "home!"]
    assert column(spark, ["Gold​Card & Co"], text.crawl_key) == ["gold card co"]


def test_rules(spark):
    rules = [{"from": "a.b", "to": "$&!"}, {"ignorePattern": "x+", "flags": "i"}]
    assert column(spark, ["A.B aXb Xxx xx", None], lambda c: text.with_rules(c, rules)) == ["A.B! ab Xxx xx", ""]


def test_slug_and_fields(spark):
    row = spark.range(1).select(text.slug(F.lit(7), F.lit("a"), F.lit("b")), text.slug(F.lit(12345), F.lit("a"), F.lit("b")))
    assert list(row.first()) == ["pair-0007-0eab8a0a33", "pair-12345-0eab8a0a33"]
    assert column(spark, ["a", 'say "x"', "a,b", None, "l\nm"], text.csv_field) == ["a", '"say ""x"""', '"a,b"', "", '"l\nm"']
    assert column(spark, ["Go", "→ →", "Buy now", "x1"], text.is_noise) == [True, True, False, True]
    assert column(spark, ["Text size:", "m", "Menu"], text.is_chrome) == [True, True, False]


def lines(spark, values, pair=1):
    return spark.createDataFrame([(pair, i, v) for i, v in enumerate(values)], "pair_id int, ord int, line string")


SOURCE = ["WELCOME to our  store", "Contact us", "Do advance bookings online.", "Welcome to our shop today", "You welcome to our store", "us", "日本語"]
TARGET = ["Welcome to our store", "Contact us today", "Do advance bookings", "online"]


def test_audit(spark):
    found = audit.audit_lines(lines(spark, SOURCE), lines(spark, TARGET)).orderBy("ord").collect()
    assert [r.match_type for r in found] == ["exact", "substring", "substring", "missing", "partial", "missing", "missing"]
    assert [r.token_coverage for r in found] == [None, None, None, 0.6, 0.8, None, None]
    total = audit.audit_summary(audit.audit_lines(lines(spark, SOURCE), lines(spark, TARGET))).first()
    assert (total.exact_lines, total.substring_lines, total.partial_lines, total.missing_lines, total.status) == (1, 2, 1, 3, "discrepancies")
    assert abs(total.coverage - 4 / 7) < 1e-12


def test_metrics(spark):
    normal = lambda v: lines(spark, v).withColumn("line", text.line("line"))
    m = audit.line_metrics(normal(SOURCE), normal(TARGET)).first()
    assert (round(m.recall, 9), round(m.jaccard, 9)) == (round(1 / 7, 9), 0.1)
    m = audit.line_metrics(normal(TARGET), normal(TARGET)).first()
    assert (m.recall, m.jaccard) == (1.0, 1.0)


def test_longest_run(spark):
    keys = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, "a b a b c"), (4, "a b a b")], "pair_id int, key string")
    blobs = spark.createDataFrame([(1, " x b c y "), (2, "  "), (3, " a b c a b a b "), (4, " b a b a b ")], "pair_id int, blob string")
    assert {r.pair_id: r.longest for r in audit.longest_runs(keys, blobs, ["pair_id"]).collect()} == {1: 2, 3: 4, 4: 4}


def test_content(spark):
    def side(desktop, mobile):
        rows = [(1, p, r, i, v) for p, r, vs in (("desktop", 0, desktop), ("mobile", 1, mobile)) for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "pair_id int, profile string, rank int, ord int, line string")

    source = side(["alpha beta gamma delta", "one two"], ["alpha beta gamma delta", "mobile only text here"])
    target = side(["one two"], ["alpha beta gamma delta"])
    found = {(r.classification, r.missing_under_profile, r.source_line) for r in content.rollup(source, target).collect()}
    assert found == {("viewport_shifted", "desktop", "alpha beta gamma delta"), ("missing_entirely", "mobile", "mobile only text here")}


def test_screening(spark):
    cases = [
        (0.94, 0.96, 0.85, "pass", ["pass_all_signals"]),
        (0.9399, 0.96, 1.0, "needs_ai", ["image_below_pass"]),
        (0.30, 0.20, 1.0, "fail", ["extreme_low_image", "extreme_low_text_recall"]),
        (0.30, 0.90, 3.0, "fail", ["extreme_low_image", "extreme_height_mismatch"]),
        (0.30, 0.90, 1.0, "needs_ai", ["image_below_pass", "text_below_pass"]),
        (0.30, 0.90, 0.0, "needs_ai", ["image_below_pass", "text_below_pass", "height_outside_pass_band"]),
        (0.745, 0.737, 1.044, "needs_ai", ["image_below_pass", "text_below_pass"]),
        (0.735, 0.792, 1.014, "needs_ai", ["image_below_pass", "text_below_pass"]),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, image double, recall double, ratio double")
    told = rows.withColumn("s", screening.verdict(F.col("image"), F.col("recall"), F.col("ratio"))).orderBy("i").collect()
    assert [(r.s.verdict, r.s.reasons) for r in told] == [c[3:] for c in cases]
    worst = spark.createDataFrame([(1, "pass"), (1, "fail"), (2, "pass")], "pair_id int, verdict string")
    assert {tuple(r) for r in screening.worst(worst).collect()} == {(1, "fail"), (2, "pass")}
    ratio = spark.range(1).select(screening.height_ratio(F.lit(0), F.lit(0)), screening.height_ratio(F.lit(5), F.lit(0))).first()
    assert list(ratio) == [1.0, 0.0]
    assert screening.Thresholds.loaded({"SCREEN_PASS_IMAGE_MIN": "0.5", "SCREEN_FAIL_REQUIRE_ALL": "true", "SCREEN_FAIL_IMAGE_MAX": "x"}) == screening.Thresholds(
        pass_image_min=0.5, fail_require_all=True
    )


def test_recipe():
    loaded, errors, warnings = recipe.load("profiles: [desktop, watch]\nnormalize: [{from: a, to: b}]\nignore: [{selector: ' '}]", strict=False)
    assert errors == ["ignore[0] needs a selector"] and warnings == ["unknown profile 'watch'"]
    assert loaded["normalize"] == [{"from": "a", "to": "b"}] and loaded["mask"] == []
    assert recipe.with_defaults(None)["profiles"] == ["desktop"]
    assert recipe.provenance(loaded, "x") == recipe.PROVENANCE
    assert recipe.profile()["viewport"] == (1920, 1080)


def test_longest_runs_are_those_of_brute_force(spark):
    import random

    pick = random.Random(5)
    some = lambda n: " ".join(pick.choice("abc") for _ in range(n))
    source = [(p, o, some(pick.randrange(0, 9))) for p in range(12) for o in range(8)]
    source += [(0, 0, source[0][2]), (0, 99, None), (77, 0, "a b c d")]  # repeated, null, and a pair without target
    target = [(p, o, some(pick.randrange(0, 7))) for p in range(12) for o in range(9)]
    schema = "pair_id long, ord long, line string"
    found = audit.audit_lines(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Nested" not in plan and "Cartesian" not in plan
    rows = found.collect()
    assert len(rows) == len(source)
    kinds = set()
    for r in rows:
        stream = f" {' '.join(t for p, _, t in target if p == r.pair_id and t)} "
        words = r.key.split()
        longest = max((j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if f" {' '.join(words[i:j])} " in stream), default=0)
        kinds.add(r.match_type)
        if r.match_type in ("partial", "missing") and len(words) >= audit.LEAST_TOKENS:
            assert abs(r.token_coverage - longest / len(words)) < 1e-12
            assert (r.match_type == "partial") == (longest / len(words) >= audit.LEAST_COVERAGE)
        else:
            assert r.token_coverage is None
    assert kinds == {"exact", "substring", "partial", "missing"}


def test_metrics_with_nulls_and_one_sided_pairs(spark):
    schema = "pair_id long, line string"
    source = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (1, None), (2, "x"), (4, None)], schema)
    target = spark.createDataFrame([(1, "x"), (1, "z"), (3, "x"), (4, "q")], schema)
    got = {r.pair_id: tuple(r)[1:] for r in audit.line_metrics(source, target).collect()}
    assert got == {1: (3, 2, 2, 2 / 3, 1 / 3), 2: (1, 0, 0, 0.0, 0.0), 3: (0, 1, 0, 1.0, 0.0), 4: (0, 1, 0, 1.0, 0.0)}


def test_an_audit_shuffles_each_side_once(spark):
    schema = "pair_id long, ord long, line string"
    source = spark.createDataFrame([(1, 0, "a b c d e f"), (1, 1, "a b x c d e"), (2, 0, "a b c d e")], schema)
    target = spark.createDataFrame([(1, 0, "x a b c d"), (1, 1, "x c d e y"), (2, 0, "")], schema)
    found = audit.audit_lines(source, target)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 2  # the words of a page become no rows
    assert {(r.pair_id, r.ord): round(r.token_coverage * len(r.key.split())) for r in found.collect()} == {(1, 0): 4, (1, 1): 4, (2, 0): 0}


def test_searches_before_expressions_change_no_text(spark):
    from pagelattice.functions import text

    odd = ["a" + chr(c) + "b" + chr(c) for c in [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    odd += [None, "", "  x  y ", "ÄÖ  ü​\tß", "S", " text size: ", "s \x85", "s" + " " * 80 + "\x85", "​ m", "letter  spacing:", "plain text"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), text.NO_WIDTH, ""), text.SPACE, " ")))
    bare = F.regexp_replace("t", f"^{text.SPACE}|{text.SPACE}$", "")
    chrome = F.rlike(bare, F.lit(text.CHROME[0])) | F.rlike(bare, F.lit(text.CHROME[1])) | F.rlike(bare, F.lit(text.CHROME[2]))
    for r in rows.select("t", text.line("t").alias("a"), plain.alias("b"), text.is_chrome(F.col("t")).alias("c"), chrome.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), repr(r.t)
    assert "transform" in rows.select(text.line("t"))._jdf.queryExecution().optimizedPlan().toString()  # searched once, then replaced


def test_keys_of_workers_are_those_of_columns(spark):
    rows = [f"A{chr(c)}b{chr(c)} {chr(c)}0" for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["", " ", None, "ΑΣ Σ", "ﬁ ＡＢ１", "Two  words here"]
    found = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.key("t").alias("k")).collect()
    assert [r.k for r in found] == [text.key_of(r.t) for r in found]

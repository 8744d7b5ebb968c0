"""A run over made captures: every file read back, and a failed pair that stops nothing."""

import pytest

from pagelattice import run
from pagelattice.sources import sinks

A, B = "a first line of some length, with words", "another line, quoted \"so\""
C, D = "the third line stands on the phone alone", "line four has moved down the page a bit"


@pytest.fixture(scope="module")
def captures(spark):
    pairs = run.pair_list(spark.createDataFrame([(i, f"https://a/{i}", f"https://b/{i},x") for i in range(1, 5)], "idx long, source_url string, target_url string"))
    rows = []

    def page(pair, role, profile, lines, kind="visible"):
        rows.extend((pair, role, profile, int(profile == "mobile"), kind, n, line) for n, line in enumerate(lines))

    for role in ("source", "target"):
        for profile in ("desktop", "mobile"):
            page(1, role, profile, [A, B])
    page(2, "source", "desktop", [A, B, C])
    page(2, "source", "mobile", [A])
    page(2, "target", "desktop", [A])
    page(2, "target", "mobile", [A, C])
    page(3, "source", "desktop", [A])
    page(3, "target", "desktop", ["nothing of it"])
    page(3, "target", "desktop", [A], "expanded")
    page(4, "source", "desktop", [A])
    page(4, "target", "desktop", [A])
    lines = spark.createDataFrame(rows, "pair_id long, role string, profile string, rank int, kind string, ord long, line string")
    items = [(2, "source", n, t, 5, 20 * n, 80, 16) for n, t in enumerate([D, A, B])] + [(2, "target", n, t, 5, 30 * n, 80, 16) for n, t in enumerate([A, "new text over here", D])]
    items += [(4, "source", 0, A, 0, 0, 1, 1)]
    scores = [(p, f, 1.0 if p == 1 else 0.1 if p == 3 else 0.6, 100, 100) for p in (1, 2, 3, 4) for f in ("desktop", "mobile")]
    return run.Captures(
        pairs, lines,
        spark.createDataFrame(items, "pair_id long, role string, ord int, text string, x int, y int, w int, h int"),
        spark.createDataFrame(scores, "pair_id long, profile string, image_similarity double, source_height int, target_height int"),
        spark.createDataFrame([(4, "no page")], "pair_id long, error string"),
    )


def test_run(spark, captures, tmp_path):
    folder = str(tmp_path / "run")
    pairs = {r.pair_id: r for r in run.run(spark, captures, run.Config(folder)).collect()}
    assert sorted(pairs) == [1, 2, 3, 4]
    assert [pairs[i].verdict for i in (1, 2, 3, 4)] == ["pass", "needs_ai", "fail", None]
    assert [pairs[i].finished_reason for i in (1, 2, 3, 4)] == [None, None, "screening_fail", "capture_failed"]
    assert [(pairs[i].text_status, pairs[i].text_reason) for i in (1, 2, 3, 4)] == [
        ("ok", None), ("discrepancies", None), ("skipped", "skipped_screening_fail"), ("skipped", "capture_failed"),
    ]
    assert (pairs[2].content_missing_entirely, pairs[2].content_viewport_shifted, pairs[2].layout_moved_count) == (1, 1, 1)

    def file(name):
        found = spark.read.option("header", "true").option("escape", '"').csv(f"{folder}/files/{name}")
        assert found.columns == sinks.columns_of(name)
        return sorted(map(tuple, found.drop("slug").collect()), key=str)

    urls = ("https://a/2", "https://b/2,x")
    assert file("text-missing") == [(*urls, "needs_ai", None, "1", B), (*urls, "needs_ai", None, "2", C)]
    assert file("content-missing") == [("missing_entirely", "desktop", B, *urls), ("viewport_shifted", "desktop", C, *urls)]
    assert file("layout-missing") == [("40", "5", B, *urls)]
    assert file("layout-moved") == [("0", "60", D, *urls)]
    assert [(r[0], r[1], r[2], r[3]) for r in file("screening-summary")] == [("fail", "1", "0.1", "0.0"), ("needs_ai", "0", "0.6", "0.3333333333333333"), ("pass", "0", "1.0", "1.0")]
    assert [r[:2] for r in file("screening-by-profile")].count(("mobile", "pass")) == 1
    reports = spark.read.json(f"{folder}/pairs/pair-report")
    assert {r.slug for r in reports.select("slug").collect()} == {r.slug for r in captures.pairs.collect()}
    assert spark.read.json(f"{folder}/files/summary-lines").count() == 4


def test_lazy_and_written_runs_agree(spark, captures, tmp_path):
    lazy, kept = (run.Run(captures, run.Config(f)) for f in (None, str(tmp_path / "kept")))
    for name, make in lazy.files.items():
        assert sorted(make().collect(), key=str) == sorted(kept.files[name]().collect(), key=str)


def test_expanded_lines_are_preferred(captures):
    of = lambda e: {r.line for r in run.lines_to_audit(captures.lines, e).where("pair_id = 3 and role = 'target'").collect()}
    assert of(True) == {A}
    assert of(False) == {"nothing of it"}


def test_rounds_are_merged(spark):
    rounds = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "b"), (1, 1, 1, "c"), (1, 2, 0, "a")], "pair_id long, round int, ord int, line string")
    lines, added = run.merged_rounds(rounds, ["pair_id"])
    assert sorted((r.round, r.line) for r in lines.collect()) == [(0, "a"), (0, "b"), (1, "c")]
    assert sorted((r.round, r.added) for r in added.collect()) == [(0, 2), (1, 1), (2, 0)]


def test_lists_of_answers(spark):
    schema = (
        "slug string, source_url string, target_url string, capture_error string, missing array<struct<iter:int,crop_path:string,label:string>>, "
        "extra_on_target array<struct<label:string,y:int,height:int>>, reordered_matches array<struct<iter:int,placement:string,label:string>>"
    )
    rows = [("p1", "s", "t", None, [(1, "c.png", None), (2, "d.png", "x")], None, [(1, None, "l")]), ("p2", "s", "t", "bad", [(1, "e", "f")], [("g", 1, 2)], [])]
    found = run.capture_lists(spark.createDataFrame(rows, schema))
    assert {n: df.columns for n, df in found.items()} == {n: sinks.columns_of(n) for n in found}
    assert sorted(map(tuple, found["missing"].collect())) == [("p1", 1, "c.png", "", "s", "t"), ("p1", 2, "d.png", "x", "s", "t")]
    assert found["extra-on-target"].collect() == []
    assert [tuple(r) for r in found["reordered-matches"].collect()] == [("p1", 1, "", "l", "s", "t")]


def test_names_alone_ask_for_no_screening(spark):
    """Files without a verdict read the texts of both sides once, and none for screening; each text is shuffled once, also without broadcasts."""
    from pagelattice.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("run_layout_moved", "run_layout_missing"):
            found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
            assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 2
            assert plan.count("REPARTITION_BY_NUM") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_content_shuffles_a_side_once(spark):
    """Neither the failed pairs, nor the profiles, nor the second look over all of them deal the texts again, also without broadcasts."""
    from pagelattice.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.QUERIES["run_content_missing"](spark, "/root/testdata/sf0.001")
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
        assert sum("REPARTITION_BY_NUM" in line for line in dealt) == 2
        assert len(dealt) == 4  # and the failed pairs and the names
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

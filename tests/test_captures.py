"""Captures in folders: pruned scans, attempts, and a run from files alone."""

import json

import pytest
from pyspark.sql import functions as F

from pagelattice import run
from pagelattice.sources import captures

A, B, C = "a first line of some length, with words", "another line of the page", "the last line there is"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")

    def put(pair, role, profile, name="a", raw=None, **fields):
        place = root / f"pair_id={pair}" / f"role={role}" / f"profile={profile}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{name}.json").write_text(raw if raw is not None else json.dumps(fields))

    for profile in ("desktop", "mobile"):
        put(1, "source", profile, attempt=0, height=100, visible=[A, B], items=[{"text": A, "x": 0, "y": 0, "w": 9, "h": 9}])
        put(2, "source", profile, attempt=0, height=100, visible=[A])
    put(1, "target", "desktop", "a", attempt=0, error="timeout")
    put(1, "target", "desktop", "b", attempt=2, height=90, visible=[A], expanded=[A, C], items=[{"text": A, "x": 0, "y": 0, "w": 9, "h": 9}])
    put(1, "target", "desktop", "c", attempt=3, height=80, visible=["later"])
    put(1, "target", "desktop", "d", attempt=3, height=80, visible=["later"])
    put(1, "target", "mobile", attempt=0, height=70, visible=[A, B])
    put(1, "target", "watch", attempt=0, height=70, visible=[A, B])
    put(2, "target", "desktop", "a", raw="{ no json")
    put(2, "target", "desktop", "b", attempt=6, height=1, visible=[A])
    return str(root)


@pytest.fixture(scope="module")
def pairs(spark):
    return run.pair_list(spark.createDataFrame([(1, "https://a/1", "https://b/1"), (2, "https://a/2", "https://b/2")], "idx long, source_url string, target_url string"))


def test_filters_decide_which_folders_are_opened(spark, folder):
    found = captures.read(spark, folder).where("pair_id = 1 and role = 'target' and profile = 'desktop'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pair_id" in plan.replace("\n", "")
    names = {r[0] for r in found.select(F.input_file_name()).collect()}
    assert found.rdd.getNumPartitions() <= 4 and len(names) == 4 and all("pair_id=1/role=target/profile=desktop" in n for n in names)


def test_attempts(spark, folder, pairs):
    found = {(r.pair_id, r.role, r.profile): r for r in captures.settled(captures.read(spark, folder), captures.wanted(pairs, ["desktop", "mobile"])).collect()}
    assert len(found) == 8
    one = found[1, "target", "desktop"]
    assert (one.error, one.height, one.visible, one.attempts, one.waited, one.rank) == (None, 90, [A], 3, 15000, 0)
    assert [found[2, "target", p].error for p in ("desktop", "mobile")] == ["broken capture", "not captured"]
    assert found[2, "target", "mobile"].attempts == 0
    waits = [r[0] for r in spark.range(7).orderBy("id").select(captures.wait_before(F.col("id").cast("int"))).collect()]
    assert waits == [0, 5000, 15000, 30000, 50000, 75000, 100000]


def test_run_from_files(spark, folder, pairs, tmp_path):
    similarity = spark.createDataFrame([(p, f, 0.9) for p in (1, 2) for f in ("desktop", "mobile")], "pair_id long, profile string, image_similarity double")
    given = captures.of_run(spark, folder, pairs, similarity)
    got = {r.pair_id: r for r in run.run(spark, given, run.Config(str(tmp_path / "run"), audit_failed=True)).collect()}
    assert got[1].capture_error is None and got[2].finished_reason == "capture_failed"
    assert (got[1].text_source_lines, got[1].text_exact_lines, got[1].text_missing_lines) == (2, 1, 1)


def test_written_captures_are_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(0, None, 5, [A], None, [(A, 1, 2, 3, 4)], 7, "source", "desktop")], f"{captures.FIELDS}, {captures.PLACE}")
    captures.write(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in captures.read(spark, str(tmp_path / "c")).collect()] == [tuple(r) for r in rows.collect()]
    empty = spark.createDataFrame([], f"{captures.FIELDS}, {captures.PLACE}")
    grid = captures.wanted(run.pair_list(spark.createDataFrame([(1, "a", "b")], "idx long, source_url string, target_url string")), ["desktop"])
    assert [r.error for r in captures.settled(empty, grid).collect()] == ["not captured"] * 2

"""Re-runs over a stream of captures: what was compared before is not compared again, also after a restart."""

import json

from pyspark.sql import functions as F

from pagelattice.streaming import runs

SCHEMA = "pair_id long, role string, profile string, captured_at timestamp, visible array<string>"


def capture(pair, text, at="2024-01-01T00:00:00", role="source"):
    return {"pair_id": pair, "role": role, "profile": "desktop", "captured_at": at, "visible": text and [text]}


def rerun(spark, folder, sets):
    """Writes each of ``sets`` and starts the query anew after it; gives the rows of all batches."""
    inputs, out, checkpoint = folder / "in", folder / "out", folder / "checkpoint"
    inputs.mkdir(parents=True)

    def analyse(batch):
        return batch.select("pair_id", "role", F.to_json("visible").alias("visible"))

    for n, rows in enumerate(sets):
        (inputs / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(SCHEMA).json(str(inputs))
        query = runs.each_batch(runs.new_captures(stream, ["visible"]), analyse, str(out), str(checkpoint))
        assert query.awaitTermination(120)
        assert query.exception() is None
    found = spark.read.schema("pair_id long, role string, visible string, batch long").parquet(str(out))
    return sorted((str(r.pair_id), r.role, r.visible, r.batch) for r in found.collect())


def test_two_starts_give_what_one_gives(spark, tmp_path):
    first = [capture(1, "a"), capture(1, "a"), capture(1, "a", role="target"), capture(2, None), capture(None, "n")]
    again = [capture(1, "a", "2024-01-02T00:00:00"), capture(1, "b"), capture(2, None), capture(None, "n"), capture(3, "c")]
    apart = rerun(spark, tmp_path / "two", [first, again])
    whole = rerun(spark, tmp_path / "one", [first + again])
    assert [r[:3] for r in apart] == [r[:3] for r in whole]
    assert len(whole) == 6
    early = {r[:3] for r in apart if r[3] == 0}
    assert ("1", "source", '["b"]') not in early and ("1", "source", '["a"]') in early


def test_state_goes_after_its_time(spark, tmp_path):
    """Ten days later the same page counts as new; in between it does not."""
    days = [[capture(1, "a", f"2024-01-{d:02}T00:00:00")] for d in (1, 3)]
    later = [[capture(9, "z", "2024-01-20T00:00:00")], [capture(1, "a", "2024-01-21T00:00:00")]]
    found = rerun(spark, tmp_path / "days", days + later)
    assert [r[:3] for r in found].count(("1", "source", '["a"]')) == 2


def test_captures_without_a_time(spark, tmp_path):
    """They all come through, and make no other capture late."""
    found = rerun(spark, tmp_path / "none", [[capture(1, "a", None), capture(1, "a", None)], [capture(2, "b", "2020-01-01T00:00:00")], [capture(2, "b", "2020-01-02T00:00:00")]])
    assert [r[:3] for r in found] == [("1", "source", '["a"]')] * 2 + [("2", "source", '["b"]')]

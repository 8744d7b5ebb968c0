from pyspark.sql import functions as F

from pagelattice.functions import geometry
from pagelattice.operators import crawl, gates
from pagelattice.operators.gates import MatchThresholds, accept

USE = MatchThresholds()


def rect(y, h, x=0.0, w=100.0):
    return {"x": x, "y": float(y), "width": w, "height": float(h)}


def test_acceptance():
    page = (1000, 1000)
    told = accept(True, 0.95, rect(0, 100), rect(180, 100), page, [], USE)
    assert (told["placement"], told["reasons"]) == ("lower_on_page", ["relative_vertical_offset_exceeded"])
    told = accept(True, 0.88, rect(0, 100), rect(180, 100), page, [], USE)
    assert told["reasons"] == ["reordered_low_confidence", "relative_vertical_offset_exceeded"]
    assert accept(True, 0.9, rect(0, 100), rect(0, 300), page, [], USE)["accepted"]
    assert accept(True, 0.84, rect(0, 100), rect(0, 100), page, [], USE)["reasons"] == ["confidence_below_min"]
    assert accept(True, 0.95, rect(0, 10, 0, 10), rect(0, 10, 5, 10), page, [rect(0, 10, 0, 10)], USE)["reasons"] == ["overlaps_prior_match"]
    assert accept(False, None, rect(0, 1), None, page, [], USE)["reasons"] == ["ai_not_found"]
    assert abs(gates.overlap(rect(0, 10, 0, 10), rect(0, 10, 5, 10)) - 1 / 3) < 1e-12


def test_card_rows(spark):
    b = lambda y, h: geometry.box(F.lit(0), F.lit(y), F.lit(100), F.lit(h))
    row = spark.range(1).select(
        geometry.is_card_row(F.lit("Hero cards")),
        geometry.is_card_row(F.lit("card row")),
        geometry.extended_row(b(0, 500), F.lit("card row"), F.lit(2000))["height"],
        geometry.extended_row(b(0, 300), F.lit("card row"), F.lit(2000))["height"],
        geometry.merged_row(geometry.box(*map(F.lit, (10, 0, 100, 400))), geometry.box(*map(F.lit, (0, 20, 50, 60)))),
    )
    hero, cards, long, short, merged = row.first()
    assert (hero, cards, long, short, tuple(merged)) == (False, True, 620, 500, (0, 0, 110, 480))


def test_replay_merges_fragment(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    schema = f"pair_id string, iter int, label string, segment {box}, done boolean, parsed boolean, found boolean, confidence double, target {box}, width double, height double, target_width double, target_height double"
    page = (1000.0, 4000.0, 1000.0, 4000.0)
    rows = [
        ("p", 1, "card row", (0.0, 0.0, 1.0, 0.05), False, True, False, None, None, *page),
        ("p", 2, "links under cards", (0.0, 0.0, 1.0, 0.05), False, True, True, 0.95, (0.0, 0.0, 1.0, 0.15), *page),
        ("p", 3, None, None, True, True, False, None, None, *page),
    ]
    found = gates.replay(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 1
    assert (found[0].merged_from, found[0].status, found[0].finished_reason) == ([1, 2], "matched", "segment_done")


def test_presence(spark):
    corpus = crawl.corpora(spark.createDataFrame([(1, 0, "Gold Card"), (1, 1, "Benefits")], "pair_id int, ord int, text string"))
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate(["card", "ar", "card benefits", "a"])], "pair_id int, i int, t string")
    found = asked.join(corpus, "pair_id").orderBy("i").select(crawl.is_present(F.col("t"), F.col("corpus"))).collect()
    assert [r[0] for r in found] == [True, True, False, False]


def test_snap(spark):
    trigger = "pair_id int, ord int, label string, x double, y double, w double, h double"
    element = "pair_id int, e_ord int, kind string, label string, x double, y double, w double, h double"
    triggers = spark.createDataFrame([(1, 0, "Open all offers", 0.0, 0.0, 10.0, 10.0), (1, 1, "", 0.0, 20.0, 10.0, 10.0), (1, 2, "go", 0.0, 0.0, 10.0, 10.0)], trigger)
    elements = spark.createDataFrame([(1, 0, "click", "Open all offers", 0.0, 900.0, 10.0, 10.0), (1, 1, "click", "go", 0.0, 400.0, 10.0, 10.0)], element)
    found = {r.ord: (r.y, r.how) for r in crawl.snap(triggers, elements).collect()}
    assert found == {0: (900.0, "label"), 1: (170.0, "neighbours"), 2: (150.0, "neighbours")}


def test_labels_are_keyed_once(spark):
    """Filters and joins read the key that was made: no other step of the plan makes it again."""
    trigger = "pair_id int, ord int, label string, x double, y double, w double, h double"
    element = "pair_id int, e_ord int, kind string, label string, x double, y double, w double, h double"
    # the first label says nothing for longer than the part that is read first
    hidden = "\u4e2d " * 200 + "Show every offer"
    triggers = spark.createDataFrame([(1, 0, hidden, 0.0, 0.0, 10.0, 10.0), (1, 1, None, 0.0, 20.0, 10.0, 10.0)], trigger)
    elements = spark.createDataFrame([(1, 0, "click", "show every offer", 0.0, 900.0, 10.0, 10.0), (1, 1, "click", None, 0.0, 9000.0, 10.0, 10.0)], element)
    found = crawl.snap(triggers, elements)
    assert {r.ord: (r.y, r.how) for r in found.collect()} == {0: (900.0, "label"), 1: (170.0, "neighbours")}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("regexp_replace" in step for step in plan)
    assert not [step for step in plan if "regexp_replace" in step and "Generate" not in step]


def test_label_keys_are_those_of_whole_labels(spark):
    import random

    pick = random.Random(3)
    parts = ["a", "Bc", "9", " ", "  ", "-", "\u0130", "\u212a", "\u03a3", "\u4e2d", "\U0001f600", "...", "word "]
    labels = ["".join(pick.choices(parts, k=pick.choice([0, 3, 60, 120, 130, 300]))) for _ in range(400)]
    labels += [None, "", "-" * 128 + "x", "a" * 128, "a" * 129, "a" * 59 + " " * 200 + "b", "a" * 60 + " b" * 90, " " * 127 + "ab", "a-" * 64 + "b"]
    rows = crawl._labelled(spark.createDataFrame([(x,) for x in labels], "label string"), "key")
    whole = F.substring(crawl.text.crawl_key("label"), 1, crawl.LABEL)
    assert rows.count() == len(labels)
    assert rows.where(~F.col("key").eqNullSafe(whole)).collect() == []


def test_first_reveal_and_states(spark):
    lines = spark.createDataFrame([(1, 0, 0, "A"), (1, 1, 0, "a!"), (1, 1, 1, "B"), (1, 1, 2, "base")], "pair_id int, trigger int, ord int, text string")
    base = spark.createDataFrame([(1, "Base")], "pair_id int, text string")
    assert {(r.trigger, r.text) for r in crawl.first_reveals(lines, base).collect()} == {(0, "A"), (1, "B")}


def test_acceptance_in_order_is_the_plain_fold(spark):
    import random

    from pagelattice.operators.gates import accept_in_order

    pick = random.Random(7)
    box = lambda: {"x": pick.randrange(300) / 1.0, "y": pick.randrange(150) / 1.0, "width": pick.choice([0.0, 80.0, 200.0]), "height": pick.choice([0.0, 60.0, 200.0])}
    rows = [(p, i, pick.random() < 0.9, pick.choice([None, 0.8, 0.86, 0.95, 0.95]), box(), pick.choice([None, *[box()] * 5]), 1000, pick.choice([0, *[1000] * 9])) for p in range(40) for i in range(12)]
    schema = "x double, y double, width double, height double"
    df = spark.createDataFrame(rows, f"pair_id long, iter int, found boolean, confidence double, source struct<{schema.replace(' double', ':double')}>, target struct<{schema.replace(' double', ':double')}>, source_height int, target_height int")
    got = {(r.pair_id, r.iter): (r.accepted, r.reasons, r.placement) for r in accept_in_order(df.repartition(3), USE).collect()}
    hits = 0
    for p in range(40):
        prior = []
        for _, i, found, sure, source, target, *heights in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            told = accept(found, sure, source, target, tuple(heights), prior, USE)
            assert got[str(p), i] == (told["accepted"], told["reasons"], told["placement"])
            hits += "overlaps_prior_match" in told["reasons"]
            prior += [target] if told["accepted"] else []
    assert hits > 5


def test_triggers_are_those_of_brute_force(spark):
    import random

    pick = random.Random(11)
    some = lambda n: " ".join(pick.choice(["ab", "a", "bc", "Gold!", "x-y", ""]) for _ in range(n))
    missing = [(p, o, pick.choice([None, *[some(1 + pick.randrange(2))] * 4])) for p in range(10) for o in range(8)]
    revealed = [(p, o, some(pick.randrange(4)), f"t{o}") for p in range(9) for o in range(6)]
    m = spark.createDataFrame(missing, "pair_id long, ord long, text string")
    r = spark.createDataFrame(revealed, "pair_id long, ord long, text string, trigger_label string")
    key = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split())
    want = {}
    for p, o, t in missing:
        keys = [(key(x), label) for q, _, x, label in revealed if q == p]
        k = key(t)
        if keys and len(k) >= 2 and k in f" {'  '.join(x for x, _ in keys)} ":
            want[p, o] = next((label for x, label in keys if k in x or x in k), None)
    assert {(x.pair_id, x.ord): x.trigger_label for x in crawl.gated_present(m, r).collect()} == want and len(want) > 10

    groups = r.selectExpr("pair_id", "ord % 3 as g_ord", "concat('t', ord % 3) as g_label", "text").groupBy("pair_id", "g_ord", "g_label").agg(F.collect_list("text").alias("lines"))
    wanted = m.withColumn("label", F.concat(F.lit("T"), F.col("ord") % 5))
    got = {(x.pair_id, x.ord): x.g_ord for x in crawl.find_trigger(wanted, groups).collect()}
    for p, o, t in missing:
        best, k = None, key(t)
        for g in range(3 if p < 9 else 0):
            lines = [key(x) for q, n, x, _ in revealed if q == p and n % 3 == g]
            by_label, by_text = f"t{o % 5}" == f"t{g}", bool(k) and any(x and (x in k or k in x) for x in lines)
            if by_label or by_text:
                best = min(x for x in (best, (0 if by_label and by_text else 1 if by_label else 2, g)) if x is not None)
        assert got[p, o] == (best[1] if best else None)


BOX = "struct<x:double,y:double,width:double,height:double>"
MORE = f"array<struct<segment:{BOX},label:string,done:boolean>>"
ANSWERS = (
    f"pair_id string, iter int, label string, segment {BOX}, done boolean, parsed boolean, found boolean, confidence double, target {BOX}, "
    f"width double, height double, target_width double, target_height double, retries {MORE}, expansions {MORE}"
)


def answer(pair, i, label, segment, target=None, retries=None, expansions=None, done=False, parsed=True, height=2000.0):
    return (pair, i, label, segment, done, parsed, target is not None, 0.95 if target else None, target, 1000.0, height, 1000.0, height, retries, expansions)


def test_replay_with_attempts(spark):
    strip = (0.0, 0.0, 1.0, 0.1)
    rows = [
        # no box at first: the second retry has one; then a page whose rest is below the least height
        answer("retry", 1, None, None, None, [(None, "Text", False), ((0.0, 0.0, 1.0, 0.99), None, False)]),
        answer("retry", 2, "x", strip),
        answer("done", 1, "Text", strip),
        answer("done", 2, "Text", (0.0, 0.0, 0.0, 0.1), None, [(None, None, True)]),
        answer("never", 1, "Text", strip),
        answer("never", 2, "Text", None, None, [(None, None, False), (None, None, False), (strip, None, False)]),
        # a row of cards: a first expansion is taken, one that does not grow ends the asking, the row reaches 200 px further
        answer("grow", 1, "card row", (0.0, 0.0, 1.0, 0.05), None, None, [((0.0, 0.0, 1.0, 0.15), "card row", False), ((0.0, 0.0, 1.0, 0.14), "card row", False), ((0.0, 0.0, 1.0, 0.4), "card row", False)]),
        answer("high", 1, "card row", (0.0, 0.0, 1.0, 0.4), None, None, [((0.0, 0.0, 1.0, 0.5), "card row", False)]),
        # too small: passed over, and the page moves on; small targets are no targets
        answer("small", 1, "Text", (0.0, 0.0, 0.04, 0.1)),
        answer("small", 2, "Text", strip, (0.0, 0.1, 1.0, 0.01)),
        answer("small", 3, None, None, None, None, None, False, False),
        # a merge takes the earlier match back, so that the merged row may be matched in its place
        answer("revoke", 1, "card row", (0.1, 0.05, 0.5, 0.1), (0.1, 0.05, 0.5, 0.1)),
        answer("revoke", 2, "links", (0.0, 0.01, 1.0, 0.05), (0.0, 0.05, 1.0, 0.26)),
        answer("revoke", 3, None, None, None, None, None, True),
    ]
    found: dict = {}
    for r in sorted(gates.replay(spark.createDataFrame(rows, ANSWERS).repartition(3)).collect(), key=lambda r: (r.pair_id, r.iter)):
        found.setdefault(r.pair_id, []).append(r)
    one = found["retry"]
    assert [(r.iter, r.label, r.height, r.attempts, r.finished_reason) for r in one] == [(1, "Text", 1980.0, 2, "source_exhausted")]
    assert [(r.iter, r.finished_reason) for r in found["done"]] == [(1, "segment_done")]
    assert [(r.iter, r.finished_reason) for r in found["never"]] == [(1, "invalid_segment_bbox")]
    assert [(r.height, r.attempts) for r in found["grow"]] == [(500.0, 2)]
    assert [(r.height, r.attempts) for r in found["high"]] == [(800.0, 0)]
    assert [(r.status, r.y, r.reasons) for r in found["small"]] == [("skipped", 0.0, ["bbox_too_small"]), ("missing", 200.0, ["bbox_too_small"])]
    assert found["small"][-1].finished_reason == "segment_parse_failed"
    (r,) = found["revoke"]
    # the first row became 400 px high by extension; 15 px and 75 px of links follow, and the row reaches down to its least height
    assert (r.merged_from, r.status, r.label, r.remainder_top, r.y) == ([1, 2], "matched", "card row (images + links)", 0.0, 100.0)
    assert r.height == min(620, 400 + 15 + 75 + 200) and r.finished_reason == "segment_done"


def test_answers_that_are_not_needed_are_not_made():
    """Nested columns give what ``to_pylist`` gives; a list's values are made when it is walked, also in a slice with nulls."""
    import pyarrow as pa

    from pagelattice.operators import gates

    rows = [[{"a": 1, "b": {"x": 1.5, "l": [{"s": "u"}, None]}, "c": True}, {"a": None, "b": None, "c": None}], [], None, [{"a": 3, "b": {"x": None, "l": None}, "c": False}]] * 2
    column = pa.array(rows).slice(1, 6)
    whole = lambda v: [whole(x) for x in v] if isinstance(v, gates._Later) else {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else v
    make = gates._maker(column)
    assert [whole(make(i)) for i in range(6)] == column.to_pylist()
    assert isinstance(next(iter(gates._maker(column.slice(3, 1))(0)))["b"]["l"], gates._Later)

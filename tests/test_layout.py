import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pagelattice.operators import images, layout

ITEM = "pair_id string, ord int, text string, x int, y int, w int, h int, font_size int"


def items(spark, rows):
    return spark.createDataFrame([("p", i, t, x, y, 50, 16, 16) for i, (t, x, y) in enumerate(rows)], ITEM)


def test_reading_order(spark):
    found = layout.with_deltas(layout.ordered_items(items(spark, [("a", 100, 0), ("b", 0, 4), ("c", 0, 30)]), ["pair_id"]), ["pair_id"])
    assert [(r.text, r.dx, r.dy) for r in found.orderBy("index").collect()] == [("b", 0, 0), ("a", 100, -4), ("c", -100, 30)]


def test_coalesce():
    row = {"text": "Do", "norm": "do", "x": 0, "y": 0, "w": 20, "h": 16, "font_size": 16}
    found = layout.coalesced(pd.DataFrame([row, row | {"text": "it", "norm": "it", "x": 25}, row | {"text": "far", "norm": "far", "x": 200}]))
    assert found["text"].tolist() == ["Do it", "far"] and found["w"].tolist() == [45, 20]


def test_alignment(spark):
    source = items(spark, [("Intro", 0, 0), ("Features list", 0, 40), ("Pricing plans", 0, 80), ("Contact sales", 0, 120)])
    target = items(spark, [("Intro", 0, 0), ("Pricing plan", 0, 40), ("Features lists", 0, 200), ("Careers", 0, 240)])
    aligned = layout.align(source, target).cache()
    s = layout.summary(aligned).first()
    assert (s.matched_count, s.moved_count, s.missing_count, s.extra_count, s.divergence_segments, s.reflow_segments) == (2, 1, 1, 1, 2, 0)
    assert (s.coverage, s.drift_count, s.status) == (0.5, 1, "discrepancies")
    assert [(r.missing_count, r.extra_count) for r in layout.segments(aligned).orderBy("segment").collect()] == [(1, 0), (1, 2)]
    d = layout.drift(aligned).first()
    assert (d.text, d.source_gap, d.target_gap) == ("Pricing plans", 80, 40)
    idx = layout.overlay_index(aligned)
    assert [r.idx for r in idx.where("side = 'source'").orderBy("op").collect()] == ["1", "2", "3", "4"]
    assert [r.idx for r in idx.where("side = 'target'").orderBy("op").collect()] == ["1:0", "3:0", "4:1", "4:2"]


def test_reflow(spark):
    aligned = layout.align(items(spark, [("Apply now", 0, 0), ("for the card", 0, 20)]), items(spark, [("Apply now for", 0, 0), ("the card", 0, 20)]))
    s = layout.summary(aligned).first()
    assert (s.matched_count, s.missing_count, s.extra_count, s.reflow_segments, s.coverage, s.status) == (0, 0, 0, 1, 0.0, "ok")


def test_self_comparison_and_empty_side(spark):
    source = items(spark, [("One line", 0, 0), ("Two lines", 0, 20)])
    s = layout.summary(layout.align(source, source)).first()
    assert (s.coverage, s.drift_count, s.missing_count) == (1.0, 0, 0)
    s = layout.summary(layout.align(source, source.limit(0))).first()
    assert (s.missing_count, s.extra_count, s.coverage) == (2, 0, 0.0)


def test_alignment_length_against_table():
    rng = np.random.default_rng(3)
    for _ in range(50):
        alike = rng.random((rng.integers(0, 9), rng.integers(0, 9))) < 0.3
        n, m = alike.shape
        t = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                t[i + 1, j + 1] = t[i, j] + 1 if alike[i, j] else max(t[i, j + 1], t[i + 1, j])
        steps = layout.alignment(alike)
        assert sum(i >= 0 and j >= 0 for i, j in steps) == t[n, m]
        assert [i for i, _ in steps if i >= 0] == list(range(n)) and [j for _, j in steps if j >= 0] == list(range(m))


def dense_walk(alike):
    """The whole table and the walk's rule, plainly."""
    n, m = alike.shape
    t = np.zeros((n + 1, m + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i, j] = t[i + 1, j + 1] + 1 if alike[i, j] else max(t[i + 1, j], t[i, j + 1])
    steps, i, j = [], 0, 0
    while i < n and j < m:
        if alike[i, j]:
            steps.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1, j] >= t[i, j + 1]:
            steps.append((i, -1))
            i += 1
        else:
            steps.append((-1, j))
            j += 1
    return steps + [(k, -1) for k in range(i, n)] + [(-1, k) for k in range(j, m)]


def test_walk_keeps_the_rule_of_ties():
    rng = np.random.default_rng(4)
    for share in (0.02, 0.1, 0.3, 0.7):
        for _ in range(60):
            alike = rng.random((rng.integers(0, 40), rng.integers(0, 40))) < share
            assert layout.alignment(alike) == dense_walk(alike)


def test_alike_places_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma delta", "gamma delto", "pay", "buy", "credit card", "credit cards", "kredit card", "日本語の文章です", "日本語の文書です"]
    keys = [" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(150)]
    a, b = keys[:80], keys[50:]

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, before = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    def alike(x, y):
        shorter = min(len(x), len(y))
        return x == y or shorter >= 6 and edits(x, y) <= max(1, int(shorter * 0.15))

    found = layout.alike_places(a, b)
    assert [p.tolist() for p in found] == [[j for j, y in enumerate(b) if alike(x, y)] for x in a]


def test_long_pages_are_aligned_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    n = 10_000
    alike = [np.sort(rng.choice(n, 3, replace=False)) for _ in range(n)]
    tracemalloc.start()
    steps = layout.walk(alike, n)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert [i for i, _ in steps if i >= 0] == list(range(n)) == [j for _, j in steps if j >= 0]


def test_hamming(spark):
    rows = [(None, "0" * 16), ("0", "00"), ("0" * 16, "f" * 16), ("0" * 16, "0" * 15 + "1")]
    found = spark.createDataFrame(rows, "a string, b string").select(images.hamming_hex(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in found.collect()] == [64, 64, 64, 1]


def test_image_match(spark):
    node = "pair_id string, ord int, x double, y double, hash long"
    source = spark.createDataFrame([("p", 0, 10.0, 10.0, 5)], node)
    target = spark.createDataFrame([("p", 0, 10.0, 110.0, 4), ("p", 1, 500.0, 900.0, 5)], node)
    anchor = "pair_id string, anchor int, x double, y double, cx double, cy double"
    for rows, partner in (([("p", 0, 0.0, 0.0, 0.0, 100.0)], 0), ([], 1)):
        found = images.match_images(source, target, spark.createDataFrame(rows, anchor)).collect()
        assert [r.counterpart for r in found if r.side == "source"] == [partner]
        assert [r.idx for r in found if r.side == "target" and not r.matched] == ["i+1"]


def test_pixels():
    grey = np.tile(np.arange(90, dtype=np.uint8), (80, 1))
    assert images.difference_hash(grey, 0, 0, 90, 80) == {"hash": None, "icon": False, "flat": True}
    assert images.difference_hash(grey, 0, 0, 30, 80)["icon"]
    wave = (np.sin(np.arange(90) / 9)[None, :] * 100 + 120 + np.arange(80)[:, None]).astype(np.uint8)
    assert len(images.difference_hash(wave, 0, 0, 90, 80)["hash"]) == 16
    white, black = np.full((16, 8, 4), 255, np.uint8), np.zeros((16, 8, 4), np.uint8)
    black[..., 3] = 255
    half = white.copy()
    half[:8] = black[:8]
    assert images.compare_pixels(white, half) == {"similarity": 0.5, "bands": [0.0] * 4 + [1.0] * 4, "changed_bands": 4}


def test_pages_cost_no_call_of_their_own(spark):
    rows = [(p, i, f"item {i} of {p}", 40 * (i % 2), 20 * i, 30, 16, 16) for p in range(3) for i in (1, 0, 2)]
    both = spark.createDataFrame(rows, ITEM.replace("pair_id string", "pair_id long"))
    ordered, aligned = layout.ordered_items(both, ["pair_id"]), layout.align(both, both.where("pair_id < 2"))
    for found in (ordered, aligned, layout.alike_items(layout.prepared(both), layout.prepared(both))):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "Groups" not in plan and "MapInArrow" in plan
    assert [(r.pair_id, r.ord, r["index"]) for r in ordered.orderBy("pair_id", "index").collect()] == [(p, i, i) for p in range(3) for i in range(3)]
    assert {(r.pair_id, r.side, r.status) for r in aligned.collect()} == {(p, s, "matched") for p in "01" for s in ("source", "target")} | {("2", "source", "missing")}


def test_unlike_keys_of_equal_letters_are_not_measured(monkeypatch):
    asked = []
    monkeypatch.setattr(layout, "_edits_within", lambda a, b, most: asked.append((a, b)))
    layout.alike_places(["abcdefghijklmnopqrstuvwxyz"], ["zyxwvutsrqponmlkjihgfedcba"])
    assert not asked


def test_local_drift_is_that_of_brute_force_without_joins(spark):
    """Ties in y, lone items and rows without a pair; matches are not multiplied by a join."""
    rng = np.random.default_rng(4)
    rows = [(p, i, int(rng.integers(0, 90)), int(rng.integers(0, 4 if p == 1 else 400)), int(rng.integers(0, 90)), int(rng.integers(0, 400))) for p, n in ((1, 40), (2, 60), (3, 1), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair_id int, ord int, x int, y int, other_x int, other_y int")
    found = layout.local_drift(df)
    wanted = {}
    for p, i, x, y, ox, oy in rows:
        near = sorted((abs(r[3] - y), r[1], r[4] - r[2], r[5] - r[3]) for r in rows if p is not None and r[0] == p and r[1] != i)[:10]
        wanted[p, i] = max(abs(ox - x - np.median([n[2] for n in near])), abs(oy - y - np.median([n[3] for n in near]))) if near else 0.0
    assert {(r.pair_id, r.ord): r.drift for r in found.collect()} == wanted
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_equal_words_in_other_orders_are_not_measured(monkeypatch):
    """Their letters and letters in pairs are alike; five in a row tell them apart."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2)) for _ in range(200)]
    keys = [" ".join(rng.permutation(words)) for _ in range(30)]
    asked = []
    monkeypatch.setattr(layout, "_edits_within", lambda a, b, most: asked.append((a, b)))
    layout.alike_places(keys, keys)
    assert not asked


def test_edits_within_a_bound_are_those_of_the_table():
    rng = np.random.default_rng(9)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, before = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    for _ in range(150):
        a, b = ("".join(rng.choice(list("abc日"), rng.integers(0, 120))) for _ in range(2))
        b = a[: len(a) // 2] + b if rng.random() < 0.5 else b
        d = edits(a, b)
        assert all(layout._edits_within(a, b, d + k) == (k >= 0) for k in (-9, -1, 0, 1, 9) if d + k >= 0)
    long = "".join(rng.choice(list("abcd "), 3000))
    other = long[:1000] + "x" + long[1001:2000] + long[2003:]
    assert layout._edits_within(long, other, 4) and not layout._edits_within(long, other, 3)


def test_pairing_aligns_once_and_shuffles_a_side_once(spark):
    from pagelattice.plans import catalog

    plan = catalog.QUERIES["layout_pairing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_steps_are_those_of_the_alignment(spark):
    rng = np.random.default_rng(10)
    words = ["alpha one", "alpha ones", "beta", "s", "Text size:", "日本", "​", "gamma delta", None]
    rows = [(p, i, None if (w := words[rng.integers(9)]) is None else w, 0, 20 * i, 1, 1, 1) for p in range(9) for i in range(rng.integers(0, 9))]
    both = spark.createDataFrame(rows, ITEM.replace("pair_id string", "pair_id long"))
    source, target = both.where("ord % 2 = 0"), both.where("ord % 3 > 0 and pair_id <> 4").withColumn("ord", F.col("ord") + 100)
    rules = [{"from": "beta", "to": "gamma delta"}]
    for r in (None, rules):
        found = {(s.pair_id, s.op, s.source_ord, s.target_ord) for s in layout.steps(source, target, r).collect()}
        held = {}
        for a in layout.align(source, target, r).collect():
            held.setdefault(a.pair_id, {}).setdefault(a.op, {})[a.side] = a.ord
        wanted = {(p, op, o.get("source"), o.get("target")) for p, ops in held.items() if {s for o in ops.values() for s in o} == {"source", "target"} for op, o in ops.items()}
        assert found == wanted and found


def test_rows_of_one_side_and_status(spark):
    source = items(spark, [("Intro", 0, 0), ("Features list", 0, 40), ("Pricing plans", 0, 80), ("Contact sales", 0, 120)])
    target = items(spark, [("Intro", 0, 0), ("Pricing plan", 0, 40), ("Features lists", 0, 200), ("Careers", 0, 240)])
    whole = layout.align(source, target).collect()
    for only in (("source", "moved"), ("target", "extra"), ("source", "missing")):
        found = layout.align(source, target, only=only).collect()
        assert found and found == [r for r in whole if (r.side, r.status) == only]

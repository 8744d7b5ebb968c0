"""Valid-time enrichment against a plain fold over the batches, with ordinary and with crowded clients."""

import datetime as dt
import math
import os
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest

from pagelattice.llm import valid_time

SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, at long, flags string"
CHANGES = "change_id long, client_id long, op string, valid_at timestamp_ntz, balance double, city string, kind int"
FIRST = dt.datetime(2024, 1, 1)


def number(day, more=0):
    return 11 if day is None else max(0, min(11, math.floor(((day.date() - dt.date(1970, 1, 1)).days + more - 19723) * 12 / 152)))


def expected(sales, changes):
    changes = [c for c in dict.fromkeys(changes) if c[3] is not None]
    batch = {c: number(c[3], 0 if c[0] is None else zlib.crc32(str(c[0]).encode()) % 4) for c in changes}
    order = lambda c: (c[3], c[0] is not None, c[0] or 0)
    held, waiting, out = {}, [], []

    def emit(sale, b):
        own = held.get(sale[1], []) if sale[1] is not None else []
        fit = [c for c in own if sale[2] is not None and c[3] <= sale[2]]
        c = max(fit, key=order) if fit else (None,) * 7
        cents = None if c[4] is None or not abs(c[4]) < 9e16 else math.floor(100 * c[4] + 0.5)
        out.append(("sale", sale[0], b, len(own), c[0], cents, c[2]))

    for b in range(12):
        seen_s = [s[2] for s in sales if s[2] is not None and number(s[3]) < b]
        seen_c = [c[3] for c in changes if batch[c] < b]
        horizon = min(max(seen_s), max(seen_c)) if seen_s and seen_c else dt.datetime.min
        for c in changes:
            if batch[c] == b:
                if seen_c and c[3] < max(seen_c):
                    out.append(("late", c[0], b, None, None, None, None))
                elif c[1] is not None:
                    held.setdefault(c[1], []).append(c)
        waiting += [s for s in sales if number(s[3]) == b]
        for s in waiting:
            if s[2] is None or s[2] < horizon:
                emit(s, b)
        waiting = [s for s in waiting if not (s[2] is None or s[2] < horizon)]
        for k, own in held.items():
            old = sorted((c for c in own if c[3] <= horizon), key=order)
            held[k] = old[-1:] + [c for c in own if c[3] > horizon]
    for s in waiting:
        emit(s, 12)
    return Counter(out)


def shop(seed, n, m, hot):
    """Random tables: a hot client, ties in time, late and repeated rows, nulls in any column."""
    pick = random.Random(seed)
    client = lambda: pick.choices([1, pick.randrange(2, 12), None], [hot, 1 - hot, 0.03])[0]
    day = lambda: FIRST + dt.timedelta(hours=pick.randrange(150 * 24 // 6) * 6, minutes=pick.choice([0, 0, 7]))
    sales = []
    for i in range(n):
        at = day()
        arrived = at + dt.timedelta(days=pick.choice([0, 0, 1, 20]))
        sales.append((i if i % 50 else None, client(), at if i % 17 else None, arrived if i % 31 else None, 1, "x"))
    changes = [(i if i % 41 else None, client(), pick.choice(["I", "U", None]), day() if i % 37 else None, pick.choice([1.5, -0.005, None, float("nan"), 1e300]), "c", 2) for i in range(m)]
    return sales + sales[:9], changes + changes[:9]


@pytest.mark.parametrize(("hot", "groups"), [(0.1, 4), (0.5, 1)])
def test_enriched_sales(spark, monkeypatch, hot, groups):
    monkeypatch.setattr(valid_time, "GROUPS_A_PARTITION", groups)
    sales, changes = shop(5, 400, 300, hot)
    got = valid_time.enriched_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES))
    assert Counter(map(tuple, got.collect())) == expected(sales, changes)


def test_empty_tables(spark):
    got = valid_time.enriched_sales(spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES))
    assert got.columns == ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]
    assert got.collect() == []


def test_groups_go_to_different_partitions(spark):
    assert len(valid_time.group_ids(spark, 12)) == 12


def test_crowded_clients_are_sliced(spark):
    """A client with half of the rows is dealt over many slices, and none of them has much of it."""
    sales, changes = shop(6, 3000, 2000, 0.5)
    rows = valid_time.events(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES))
    crowd = valid_time.crowded_clients(rows, 4)
    assert set(crowd.widths) == {1}
    parts = [r["count"] for r in valid_time.dealt(rows, crowd, valid_time.group_ids(spark, 4)).where("slice <> -1").groupBy("slice").count().collect()]
    assert len(parts) > 20
    assert max(parts) < 0.1 * sum(parts)


def test_no_start_leaves_its_stores_open(spark, monkeypatch):
    """Stores of earlier starts, one for each partition, do not add up in an executor until maintenance comes by."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    locked = lambda: {p for p in Path(f"/proc/{pid}/fd").iterdir() if p.is_symlink() and os.path.basename(os.readlink(p)) == "LOCK"}
    monkeypatch.setitem(valid_time.SETTINGS, "spark.sql.streaming.stateStore.maintenanceInterval", "1h")
    monkeypatch.setattr(valid_time, "BATCHES", 1)
    before = len(locked())
    sales, changes = shop(7, 40, 30, 0.1)
    got = valid_time.enriched_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES))
    assert got.where("rec = 'sale'").count() == len(sales)
    assert len(locked()) <= before

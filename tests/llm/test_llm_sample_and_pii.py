"""Resampling and personal data against the plainest way to the same result."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from pagelattice.llm import pii, resample

SCHEMA = "doc_id long, text string, score string, run int, place string, key int, range int"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def some_texts(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本語", "ABC", "x-y"]
    texts = [" ".join(pick.choices(vocabulary, k=pick.choice([0, 5, 19, 20, 60]))) for _ in range(n)]
    rows = [(i if i % 40 else None, t if i % 23 else None) for i, t in enumerate(texts)]
    return rows + rows[:30] + [(9999, "long " * 200_000)]


def expected_sample(rows, target):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s = Counter(bucket(w) for _, t in rows for w in words(t))
    t = Counter(bucket(w) for x in target for w in words(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        own = [math.floor(1000 * math.log((t[k] + 1) * (all_s + 10000) / ((s[k] + 1) * (all_t + 10000)))) for k in map(bucket, words(text))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: 10 * len(able) // 100]
    return Counter(out), [(r[0], r[3]) for r in drawn]


@pytest.mark.parametrize("range_rows", [1 << 18, 7])
def test_resampled(spark, monkeypatch, range_rows):
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    rows, target = some_texts(1, 900), ["w1 w2 w3 Über", "w1 w7 unseen", None]
    docs = spark.createDataFrame([(i, t, "s", 1, "p", 2, 3) for i, t in rows], SCHEMA).repartition(5)
    got = resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    every, drawn = expected_sample(rows, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == every
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


def test_resampling_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resample.resampled(empty, empty.select("text")).collect() == []
    few = spark.createDataFrame([(1, None, "s", 1, "p", 2, 3), (2, "one word", "s", 1, "p", 2, 3)], SCHEMA)
    assert [r.rank for r in resample.resampled(few, empty.select("text")).collect()] == [None, None]


@pytest.mark.parametrize("sizes", [[], [0, 0], [1], [3, 0, 5], [1] * 9, [100, 1, 50, 0, 2, 7, 7]])
def test_tournament_tree(sizes):
    pick = random.Random(sum(sizes))
    runs = [sorted((pick.randrange(20), pick.randrange(3)) for _ in range(n)) for n in sizes]
    tree, out = resample.TournamentTree(runs), []
    while (found := tree.pop()) is not None:
        out.append(runs[found[0]][found[1]])
    assert out == sorted(x for run in runs for x in run)


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(kind, text):
    def good(found):
        digits = [int(c) for c in found if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [m.span() for m in PLAIN[kind].finditer(text) if good(m[0])]


def test_base_spans_are_those_of_the_patterns():
    pick = random.Random(3)
    texts = ["".join(pick.choices("ab1.@-+ 2%()é09", k=60)) for _ in range(3000)]
    texts += ["4111 1111 1111 1111 4111-1111-1111-1111", "a 4111-1111 11111111, 4111111111111112", "x@a.b@c.d.e", "1.2.3.4.5.6.7.8 256.1.1.1", "+49 (30) 1234-567", "@" * 500 + "a" * 500]
    found = Counter()
    for text in texts:
        for kind in pii.KINDS:
            spans = list(pii.FINDERS[kind](text))
            assert spans == plain(kind, text), (kind, text)
            found[kind] += len(spans)
    assert min(found.values()) > 0


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("write to jane(at)example.com!", "email", "jane(at)example.com"),
        ("mail jane dot doe at example dot co dot uk, please", "email", "jane dot doe at example dot co dot uk"),
        ("jаne＠example．com", "email", "jаne＠example．com"),
        ("é jane​@exam​ple.com ü", "email", None),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
        ("call +４９ ３０ １２３４５６７", "phone", "+４９ ３０ １２３４５６７"),
        ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("at 192[.]168[.]1[.]20 we", "ip", "192[.]168[.]1[.]20"),
    ],
)
def test_disguised(text, kind, span):
    base, added = pii.scan(text)
    shown = base if span is None and base[kind] else added
    assert len(shown[kind]) == 1
    a, b = shown[kind][0]
    assert span is None or text[a:b] == span


@pytest.mark.parametrize("text", ["look at it, dot your i", "one two three four horses at the inn", "he is (at) home now [.] then", "six un huit mots", "２０２４ was a year", "at dot at dot"])
def test_clean_texts_stay_clean(text):
    assert not any(map(any, (part.values() for part in pii.scan(text))))


def test_ways_back():
    """Each span of a rewritten text goes back to characters whose own rewriting covers it."""
    text = "a​b ＠ [at] c [dot] d"
    first = pii.plain_characters(text)
    assert first.text == "ab @ [at] c [dot] d"
    assert first.back(0, 2) == (0, 3)
    assert first.back(3, 4) == (4, 5)
    second = pii.spoken_characters(first.text)
    assert second.text == "ab @@c.d"
    assert second.back(4, 8) == (4, 19)


def test_personal_data_of_a_table(spark):
    texts = [(1, "a@b.cd, +1 (222) 333-4444, x [at] y [dot] de"), (1, "a@b.cd, +1 (222) 333-4444, x [at] y [dot] de"), (2, None), (None, ""), (3, "1" * 100_000 + "@" + "é" * 100_000)]
    docs = spark.createDataFrame([(i, t, "s", 1, "p", 2, 3) for i, t in texts], SCHEMA)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone, got[1].n_added) == (1, 0, 0, 1, 1)
    assert got[1].spans == "email:0:6,email:27:44,phone:8:25"
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,phone:8:25").hexdigest()
    assert got[2].base_sha256 == got[None].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(docs.where("false")).collect() == []

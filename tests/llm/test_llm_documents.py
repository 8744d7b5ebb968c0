"""The document operators against the plainest way to the same result, on awkward tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from pagelattice.llm import bpe, common, licenses, lm_score, packing, runs_dedup, simhash, toxicity, webp

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
SCHEMA = "doc_id long, text string, place string, print int, anchor string, n_chars long, score string, unit int"

PASSAGE = " ".join(f"passage{i} with some words that repeat" for i in range(12))
TEXTS = [
    (0, "Hello   world, this is a text.\nIt's under the MIT license."),
    (1, ""),
    (2, None),
    (3, "x"),
    (None, "no id here, but some words"),
    (4, "Hello   world, this is a text.\nIt's under the MIT license."),
    (4, "Hello   world, this is a text.\nIt's under the MIT license."),
    (5, PASSAGE),
    (6, "begin " + PASSAGE + " end é ñ 日本"),
    (7, "aaaa " * 600),
    (8, "<|endoftext|> a b 　 \x1c ß İ \r\n\t z" * 3),
    (9, "  \n\t "),
    (10, " ".join(f"word{i * i % 997}" for i in range(30000))),
    (11, "CC BY NC cc-by-nc under the mit license apache license version 2"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A Parquet scan with repeated rows, nulls in any column, long texts and columns named like those inside operators."""
    rows = [(i, t, None, None, "x", None if t is None else len(t), "s", 1) for i, t in TEXTS]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def texts():
    return [(i, t or "") for i, t in TEXTS]


def table(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_bpe(docs, none):
    codec = bpe.ForcedBoundaryCodec(BYTE)
    want = []
    for i, t in texts():
        ids = codec.tokenizer.encode(t, add_special_tokens=False).ids
        back = codec.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert table(bpe.encode_documents(docs, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.encode_documents(none, BYTE).count() == 0


def test_bpe_cuts_are_certain():
    codec = bpe.ForcedBoundaryCodec(BYTE)
    rng = np.random.default_rng(1)
    alphabet = list("ab '\n\t.,!é 日<|>0s") + ["<|endoftext|>", "'re", "  "]
    made = ["".join(rng.choice(alphabet, 40)) for _ in range(500)]
    for t, (ids, said) in zip(made, codec.encode_batch(made), strict=True):
        assert codec.tokenizer.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()
        assert said.decode() == t


def test_bpe_uses_every_certain_pair_it_can():
    """Any text between any two characters: cutting at each usable pair changes nothing, and what is left out has a reason."""
    codec = bpe.ForcedBoundaryCodec(BYTE)
    assert (codec.certain | bpe.pairs_inside(codec.bytes_of)).all() and not (codec.usable & bpe.pairs_inside(codec.bytes_of)).any()
    left_out = codec.certain & ~codec.usable
    left_out[[*range(0x21), 0x7F]] = left_out[:, 0x80:0xC0] = left_out[:, 0x27] = False
    assert not left_out.any()
    text = "cat,dog(1)日本語"
    cuts = np.flatnonzero(codec.boundaries(text.encode())).tolist()
    assert [text.encode()[a:b].decode() for a, b in zip([0, *cuts], [*cuts, None], strict=True)][:6] == ["cat", ",", "dog", "(", "1", ")"]
    rng = np.random.default_rng(2)
    kinds = ["a", "Zq", "s", "t", "re", "'", "''", "7", "½", "!", "»", "é", "ж", "日", "\u3000", "\xa0", "\u2009", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u200b", "😀", "̈"]
    made = ["".join(rng.choice(kinds, 12)) for _ in range(4000)] + [a + b + c for a in kinds for b in kinds for c in kinds]
    for t, (ids, said) in zip(made, codec.encode_batch(made), strict=True):
        assert codec.tokenizer.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), repr(t)
        assert said.decode() == t


def test_fragments_are_forgotten_and_told_apart():
    from pagelattice.llm.fragments import FragmentIds

    asked = []

    def encode(parts):
        asked.extend(parts)
        ids = [list(p) for p in parts]
        return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids])

    memory = FragmentIds(encode, most=300)
    rng = np.random.default_rng(4)
    for _ in range(60):
        parts = [rng.integers(0, 3, n, dtype=np.uint8).tobytes() for n in rng.integers(1, 24, 90)]
        ends = np.cumsum([len(p) for p in parts])
        ids, many = memory.of(b"".join(parts), ends - [len(p) for p in parts], ends)
        assert ids.tolist() == list(b"".join(parts)) and many.tolist() == [len(p) for p in parts]
    assert len(asked) > len(set(asked)) > 300  # some were forgotten and asked again


def test_packing(docs, none):
    words = packing.WordIds(WORD)
    rows = packing.pack_documents(docs, WORD).collect()
    whole = [words.tokenizer.encode(t, add_special_tokens=False).ids + [1] for _, t in texts()]
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in {i: ids for (i, _), ids in zip(TEXTS, whole, strict=True)}.items():
        copies = sum(j == i for j, _ in TEXTS)
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]})
        assert sum(r.length for r in by_doc[i]) == copies * len(ids)
        for start, length, crc, total in pieces:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and total == len(ids)
        if copies == 1:
            assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= packing.CAPACITY
    assert packing.pack_documents(none, WORD).count() == 0


def test_word_ids_beyond_latin():
    words = packing.WordIds(WORD)
    made = ["".join(chr(c) for c in range(1, 256)), "ΑΣ ΑΣ. x́\x1cy", "12!'s 5's don't 'TIS I'LL", "É<|startoftext|>b  c", ""]
    for t, ids in zip(made, words.encode_batch(made), strict=True):
        assert words.tokenizer.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_differencing():
    rng = np.random.default_rng(2)
    rose = 0
    for _ in range(200):
        lengths = rng.integers(1, 2048, rng.integers(1, 90)).tolist()
        windows = packing.packed(lengths)
        assert all(sum(lengths[i] for i in w) <= 2048 for w in windows)
        assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
        rose += len(windows) > -(-sum(lengths) // 2048)
    assert 0 < rose < 200  # the window count rises where capacity is exceeded
    assert [sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differenced([8, 7, 6, 5, 4], 2)] == [14, 16]
    assert len(packing.packed([1500] * 4, 2048)) == 4


def test_packing_pads_little():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0)
    sizes = np.minimum(rng.lognormal(5.5, 1.4, 3000).astype(int) + 1, 30_000)
    for k, n in enumerate(sizes.tolist()):
        packer.add(k, np.full(n, k, "<u4").tobytes())
    packer.finish()
    full: Counter = Counter()
    for r in packer.rows:
        full[r[5]] += r[2]
    assert sum(full.values()) == sizes.sum()
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in full.values())
    assert padded < 1.02 * sizes.sum()
    whole = Counter(r[0] for r in packer.rows)
    assert sum(whole[k] > -(-n // 2048) for k, n in enumerate(sizes.tolist())) <= len(full) // 20  # few are cut further than needed


def test_media(docs, none):
    rows = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in webp.media_documents(docs).collect()}
    want = set()
    for i, t in texts():
        p = webp.payload_of(t.encode())
        assert len(p) % 576 == 0 and p.startswith(t.encode())
        want.add((i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert rows == want
    assert webp.media_documents(none).count() == 0


def test_licences(docs, none):
    def brute(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    got = table(licenses.scan_documents(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted([(i, *brute(t)) for i, t in texts()], key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in licenses.scan_documents(docs).collect())
    assert licenses.scan_documents(none).count() == 0


def test_licence_expressions():
    read = lambda s: licenses.to_postfix(licenses.expression_tokens(s))
    assert read(" (MIT OR Apache-2.0) AND GPL-2.0+ WITH x-exception */") == ["MIT", "Apache-2.0", "or", "GPL-2.0+", "x-exception", "with", "and"]
    assert read("MIT OR BSD AND ISC") == ["MIT", "BSD", "ISC", "and", "or"]
    assert read("MIT AND") == ["MIT"] and read("-->") == [] and read("(MIT") == ["MIT"]
    assert licenses.evaluated(read("(MIT OR GPL-2.0) AND BSD")) == ({"mit", "gpl", "bsd"}, True)
    many = " AND ".join(f"(MIT OR A{i})" for i in range(40))
    assert licenses.evaluated(read(many))[1] and not licenses.evaluated(read(many + " AND GPL-2.0"))[1]
    scan = licenses.LicenceScanner().scan
    found = scan("// SPDX-License-Identifier: GPL-3.0-only OR MIT\nint x;")
    assert (found["labels"], found["satisfiable_by"], found["n_unread"]) == ("gpl,mit", "permissive", 0)
    found = scan("SPDX-License-Identifier: AND\nspdx-license-identifier:\nSPDX-License-Identifier: ISC")
    assert (found["labels"], found["n_unread"]) == ("isc", 2)


def test_licence_expressions_against_all_assignments():
    """Random expressions against a listing of all the ways to fulfil them."""
    rng = np.random.default_rng(41)
    names = ["MIT", "GPL-2.0", "BSD-3-Clause", "Weird-1", "ISC"]

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name = str(rng.choice(names))
            return name, [frozenset([licenses.family(name)])]
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        if rng.random() < 0.5:
            return f"({a} OR {b})", x + y
        return f"({a} and {b})", [p | q for p in x for q in y]

    for _ in range(200):
        text, ways = made(3)
        labels, permissive = licenses.evaluated(licenses.to_postfix(licenses.expression_tokens(text)))
        assert labels == frozenset().union(*ways) and permissive == any(w <= licenses.PERMISSIVE for w in ways)


@pytest.mark.parametrize(
    ("name", "label", "permissive"),
    [
        ("CC-BY-ND-4.0", "cc-by-nd", False), ("CC-BY-4.0", "cc-by", True), ("CC-BY-NC-SA-3.0", "cc-by-nc-sa", False), ("MITRE-1.0", "mitre-1.0", False),
        ("mitsubishi", "mitsubishi", False), ("MIT-0", "mit", True), ("ISCX", "iscx", False), ("BSD-Protection", "bsd-protection", False), ("BSD-3-Clause", "bsd", True),
        ("GPL-3.0-or-later", "gpl", False), ("LGPL-2.1+", "lgpl", False), ("Apache-2.0", "apache-2", True), ("Apache-1.1", "apache", True), ("GPLX-2.0", "gplx-2.0", False),
    ],
)
def test_whole_identifiers_have_families(name, label, permissive):
    assert licenses.evaluated([name]) == ({label}, permissive)


def test_long_expressions_take_time_in_proportion():
    import time

    for word in (" OR ", " AND "):
        text = word.join(f"A{i}" for i in range(100_000))
        began = time.perf_counter()
        labels, permissive = licenses.evaluated(licenses.to_postfix(licenses.expression_tokens(text)))
        assert (len(labels), permissive) == (100_000, False)
        assert time.perf_counter() - began < 5
    assert licenses.evaluated(licenses.to_postfix(["GPL-2.0", "with", "(", "MIT", "or", "ISC", ")", "or", "MPL-2.0"])) == ({"gpl", "mpl"}, False)


def test_licences_in_long_texts():
    import time

    scan = licenses.LicenceScanner().scan
    began = time.process_time()
    found = scan("under the MIT license, words; " * 60_000)
    assert (found["n_base"], found["first_word"], found["last_word"]) == (60_000, 0, 5 * 59_999)
    assert time.process_time() - began < 5


def brute_model(rows):
    """The interpolated score of each row, with plain counts and EM over single tokens until nothing moves."""
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    pairs_of = lambda d: list(zip([None, *d[:-1]], d, strict=True))
    train = [(fold(i), token(t)) for i, t in rows if fold(i) != 2]

    def counts(documents):
        return Counter(w for d in documents for w in d), Counter(p for d in documents for p in pairs_of(d))

    word, pair = counts([d for _, d in train])
    rest_word, rest_pair = counts([d for f, d in train if f != 3])
    distinct, total, rest_total = len(word), sum(word.values()), sum(rest_word.values())
    tokens = [p for f, d in train if f == 3 for p in pairs_of(d)]
    parts = lambda w, p, n, v, x: (p[v, x] / w[v] if w[v] else 0.0, w[x] / max(n, 1), 1 / (distinct + 1))
    weights = lm_score.first_weights()
    observed = [(rest_word[v].bit_length(), parts(rest_word, rest_pair, rest_total, v, x)) for v, x in tokens]
    b = np.array([o[0] for o in observed], int)
    p = np.array([o[1] for o in observed]).reshape(-1, 3)
    for _ in range(2000 if len(b) else 0):
        share = weights[b] * p
        share /= share.sum(1, keepdims=True)
        for k in set(b.tolist()):
            found = share[b == k].sum(0) + 1e-9
            weights[k] = found / found.sum()
    weights = lm_score.spread_weights(weights, set(b.tolist()))
    return [sum(math.log10(weights[word[v].bit_length()] @ parts(word, pair, total, v, x)) for v, x in pairs_of(token(t))) for _, t in rows]


def test_language_model(docs, none):
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None]
    train = [token(t) for i, t in texts() if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    c = Counter(w for d in train for w in d)
    total, distinct = sum(c.values()), len(c)
    got = {(r.doc_id, r.n_tokens): r for r in lm_score.score_documents(docs).collect()}
    for (i, t), model in zip(texts(), brute_model(texts()), strict=True):
        d = token(t)
        r = got[i, len(d)]
        assert (r.n_known, r.train_tokens) == (sum(c[w] > 0 for w in d), total)
        assert r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in d), rel_tol=1e-9)
        assert math.isclose(r.score, model, rel_tol=0.02)
    assert lm_score.score_documents(none).count() == 0


@pytest.mark.parametrize("batch_bytes", [1 << 20, 3000])
def test_scores_against_brute_force(spark, tmp_path, monkeypatch, batch_bytes):
    """Scores of a corpus whose words follow each other, under the weights of an EM over single tokens."""
    monkeypatch.setattr(lm_score, "BATCH_BYTES", batch_bytes)
    rng = np.random.default_rng(23)
    follow = rng.integers(0, 200, (200, 3))
    rows = []
    for i in range(150):
        at, out = int(rng.integers(0, 200)), []
        for _ in range(int(rng.integers(1, 60))):
            out.append(f"t{at}" if rng.random() < 0.95 else f"rare{rng.integers(0, 9999)}")
            at = int(follow[at, rng.integers(0, 3)]) if rng.random() < 0.8 else int(rng.integers(0, 200) ** 2 // 200)
        rows.append((i, " ".join(out)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark.read.parquet(str(tmp_path / "d"))).collect()}
    want = dict(zip([i for i, _ in rows], brute_model(rows), strict=True))
    assert max(abs(got[i] / want[i] - 1) for i in want) < 0.01


def test_scores_survive_a_change_of_cores(spark, tmp_path, monkeypatch):
    """The number of cores decides how a scan is split; it changes between the jobs."""
    path = str(tmp_path / "documents.parquet")
    rows = [(i, " ".join(f"w{i * k % 53}" for k in range(300)), None, None, "x", 1, "s", 1) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.option("parquet.block.size", 4096).parquet(path)
    cores = "spark.sql.leafNodeDefaultParallelism"
    monkeypatch.setattr(lm_score, "learned", lambda *a, _f=lm_score.learned: (_f(*a), spark.conf.set(cores, "2"))[0])
    small = {"spark.sql.files.openCostInBytes": "1", cores: "9"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        splits = spark.read.parquet(path).rdd.getNumPartitions()
        got = lm_score.score_documents(spark.read.parquet(path))
        assert spark.conf.get(cores) == "2" and spark.read.parquet(path).rdd.getNumPartitions() != splits
        assert got.count() == 400
    finally:
        for k in small:
            spark.conf.unset(k)
    by_id = lambda df: {r.doc_id: (r.base_score, r.score) for r in df.collect()}
    one, other = by_id(got), by_id(lm_score.score_documents(spark.read.parquet(path)))
    assert one.keys() == other.keys()
    assert all(one[i] == pytest.approx(other[i], rel=1e-9) for i in one)


def test_interpolation_is_a_distribution(spark):
    """Over all continuations of a context, unseen ones included, probabilities sum to one."""
    c_pair, c_word = np.array([3, 1, 0, 0]), np.array([5, 4, 1, 0])
    p2, p1, p0 = lm_score.estimates(c_pair, np.full(4, 4), c_word, 10, 3)
    seen = spark.createDataFrame([(3, 3, 4, 5, 10), (3, 0, 4, 0, 2), (1, 0, 1, 4, 7)], "bucket long, c_pair long, c_context long, c_word long, n long")
    for w in lm_score.learned(seen, 10, 3):
        assert abs(w.sum() - 1) < 1e-9
        assert abs((w[0] * p2 + w[1] * p1 + w[2] * p0).sum() - 1) < 1e-9


def test_em_stands_still_at_the_likeliest_weights(spark):
    rows = [(2, 2, 3, 5, 50), (2, 0, 3, 9, 30), (2, 0, 2, 0, 5), (2, 1, 3, 1, 11)]
    seen = spark.createDataFrame(rows, "bucket long, c_pair long, c_context long, c_word long, n long")
    value = lambda w: sum(n * math.log(w[0] * p / c + w[1] * x / 20 + w[2] / 8) for _, p, c, x, n in rows)
    found = lm_score.learned(seen, 20, 7)[2]
    grid = [(a / 50, b / 50, 1 - (a + b) / 50) for a in range(50) for b in range(50 - a)]
    assert value(found) >= max(map(value, grid)) - 1e-2


def test_count_packing():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 7])
    assert lm_score.unpack_counts(lm_score.pack_counts(counts), len(counts)).tolist() == counts.tolist()


def repeats(values, length):
    seen = Counter(t[k : k + length] for t in values for k in range(len(t) - length + 1))
    out = []
    for t in values:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"unit_bytes": 500, "hot_bytes": 1000}])
def test_repeats(docs, none, limits):
    got = table(runs_dedup.digests(docs, **limits), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = repeats([t.encode() for _, t in texts()], 200)
    assert got == sorted([(i, *w) for (i, _), w in zip(texts(), want, strict=True)], key=str)
    assert runs_dedup.digests(none).count() == 0


def test_run_index():
    """Windows that repeat, from samples at the ends of runs, against a count of all; zero bytes and equal blocks included."""
    rng = np.random.default_rng(13)
    for round_ in range(120):
        alphabet, length = int(rng.integers(1, 4)), int(rng.integers(2, 9))
        base = [rng.integers(0, alphabet, rng.integers(1, 30), dtype=np.uint8).tobytes() for _ in range(4)]
        blocks = [b"".join(base[k] for k in rng.integers(0, 4, rng.integers(1, 5))) for _ in range(rng.integers(1, 8))]
        blocks = [b for b in blocks if len(b) >= length]
        if round_ % 3 == 0:
            blocks = [bytes(x + 97 for x in b) for b in blocks]
        if not blocks:
            continue
        index = runs_dedup.RunIndex(blocks, length)
        windows = [b[k : k + length] for b in blocks for k in range(len(b) - length + 1)]
        seen = Counter(windows)
        assert index.repeated().tolist() == [seen[w] > 1 for w in windows]
        assert index.lengths.sum() == len(windows) and index.runs <= len(windows)
    # a repetitive text has few runs, and the runs are all that the index holds
    text = bytes(rng.integers(97, 123, 300, dtype=np.uint8)) * 40
    index = runs_dedup.RunIndex([text], 50)
    assert index.repeated().all() and index.runs < 700 < len(text) // 10
    held = [k for k, v in vars(index).items() if isinstance(v, np.ndarray) and v.size > index.runs]
    assert not held


def test_widened_blocks_part_all_windows():
    rng = np.random.default_rng(14)
    for _ in range(200):
        width, length = 64, 200
        more = runs_dedup.widths(length, width)[1] - width
        many = int(rng.integers(1, length - width + 2))
        core = int(rng.integers(many - 1, length - width + 1))
        block = rng.integers(0, 256, length + many - 1, dtype=np.uint8).tobytes()
        seen = []
        for base, part, at, shared in runs_dedup.widened(block, core, width, more, length):
            assert len(shared) == width + more and part == block[base : base + len(part)] and part[at : at + len(shared)] == shared
            n = len(part) - length + 1
            assert n >= 1 and n - 1 <= at <= length - len(shared)  # all windows of the part hold what it shares
            seen += range(base, base + n)
        assert seen == list(range(many))
    assert runs_dedup.widths(200, 64) == [64, 132, 166, 183, 192, 196, 198, 199, 200]


def test_hot_anchors(spark, tmp_path):
    """Hundreds of distinct surroundings of one passage: its blocks are widened until none is above the limit."""
    rng = np.random.default_rng(15)
    letters = np.array(list("abcdefghij"))
    word = lambda n: "".join(rng.choice(letters, n))
    passage, near = word(190), word(20)
    values = [word(int(rng.integers(0, 90))) + passage + near[: int(rng.integers(0, 15))] + word(int(rng.integers(0, 90))) for _ in range(250)]
    spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = table(runs_dedup.digests(spark.read.parquet(str(tmp_path / "d")), unit_bytes=5000, hot_bytes=2000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = [(i, *w) for i, w in enumerate(repeats([v.encode() for v in values], 200))]
    assert got == sorted(want, key=str) and 20 < sum(w[2] > 0 for w in want) < 250


def test_repeats_over_chunks(spark, tmp_path):
    rng = np.random.default_rng(5)
    noise = "".join(map(chr, rng.integers(97, 123, 1_200_000)))
    values = [noise + "|" + noise[300_000:300_400], "é" * 400 + noise[524_000:524_600], "z"]
    spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in runs_dedup.digests(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {0: (400 + 600 + 400, 3), 1: (600 + 800, 1), 2: (0, 0)} or got == {0: (1400, 3), 1: (1400, 2), 2: (0, 0)}


def test_cleaned_keeps_columns(docs, none):
    found = runs_dedup.cleaned(docs)
    assert found.columns == docs.columns and found.count() == len(TEXTS)
    r = found.where("doc_id = 6").first()
    assert r.text.startswith("begin") and "passage3" not in r.text and r.n_chars == len(r.text)
    assert found.where("doc_id = 2").first().text is None
    assert runs_dedup.cleaned(none).count() == 0


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    prints = [(i, plain_fingerprint(t)) for i, t in texts()]
    label = list(range(len(prints)))
    for _ in prints:
        for a, (_, p) in enumerate(prints):
            for b, (_, q) in enumerate(prints):
                if (p ^ q).bit_count() <= 3:
                    label[a] = min(label[a], label[b])
    least = {k: min((i for (i, _), m in zip(prints, label, strict=True) if m == k and i is not None), default=None) for k in label}
    got = table(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == sorted([(i, f"{p:016x}", least[k]) for (i, p), k in zip(prints, label, strict=True)], key=str)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.count() <= len(set(label))
    assert simhash.one_of_each_group(docs, lanes=1).count() == len(set(label))
    assert simhash.one_of_each_group(none).count() == 0


@pytest.mark.parametrize("anchor_rows", [1 << 16, 40])
def test_anchors_cover(spark, anchor_rows):
    """Random fingerprints and neighbours at 0 to 5 bits, against all pairs; with few rows a cell, anchors are dealt over several."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [int(sum(1 << int(b) for b in rng.choice(64, n, False))) for n in rng.integers(0, 6, 600)]
    made = {simhash.signed(int(x) ^ f) for x, f in zip(np.repeat(base, 10), flips, strict=True)}
    made |= {simhash.signed(5 << 40 | 1 << int(a) | 1 << int(b)) for a, b in rng.integers(32, 64, (150, 2))}  # one half in common
    made = sorted(made)
    want = {(a, b) for k, a in enumerate(made) for b in made[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    least = {p: p for p in made}
    for _ in made:
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    rows = [(p, lane) for p in made for lane in (0, 5)]
    spanned = simhash.spanning_links(spark.createDataFrame(rows, "print long, lane int"), anchor_rows=anchor_rows).collect()
    assert {lane: sum(r.lane == lane for r in spanned) for lane in (0, 5)}[0] >= len(made) - len(set(least.values())) > 50
    for lane in (0, 5):
        found = {p: p for p in made}
        pairs = {(r.a, r.b) for r in spanned if r.lane == lane}
        for _ in made:
            for a, b in pairs:
                found[a] = found[b] = min(found[a], found[b])
        assert found == least


def test_anchors_are_a_covering_code():
    anchors = simhash.Anchors()
    rng = np.random.default_rng(17)
    halves = rng.integers(0, 1 << 32, 4000, dtype=np.uint32)
    nearest, rows, visits = anchors.of(halves)
    assert (np.bitwise_count(nearest ^ halves) <= simhash.RADIUS).all()
    assert (anchors.syndromes(nearest & np.uint32((1 << simhash.CODE) - 1)) == 0).all()
    visited = [set() for _ in halves]
    for r, v in zip(rows.tolist(), visits.tolist(), strict=True):
        visited[r].add(v)
    for bit in range(32):  # a half one bit off lives at an anchor that is visited
        lives = anchors.of(halves ^ np.uint32(1 << bit))[0]
        assert all(x in v for x, v in zip(lives.tolist(), visited, strict=True))
    assert all(n in v and len(v) <= 17 for n, v in zip(nearest.tolist(), visited, strict=True))


def test_more_lanes_find_more(spark, tmp_path):
    """Copies of long texts with one word in fifty changed, and texts of their own."""
    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(5000)]
    rows = []
    for i in range(40):
        text = rng.choice(words, 500)
        copy = text.copy()
        copy[rng.choice(500, 10, False)] = rng.choice(words, 10)
        rows += [(i, " ".join(text)), (100 + i, " ".join(copy))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    left = [{r.doc_id for r in simhash.one_of_each_group(d, lanes=n).collect()} for n in (1, 8)]
    assert left[1] < left[0] and set(range(40)) <= left[1] and len(left[1]) < 65


def test_toxicity(spark, docs, none, tmp_path):
    rng = np.random.default_rng(9)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        lines = [" ".join(rng.choice(common, 8)) + "." for _ in range(rng.integers(1, 12))]
        if i % 4 == 0:
            lines.insert(int(rng.integers(0, len(lines))), f"you are a grimble{rng.integers(0, 9)} person.")
        rows.append((i, " ".join(lines)))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, lab).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert len(held) > 80 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    for i in held:
        if labels[i][1] and got[i].predicted:
            assert "grimble" in [s for s in rows[i][1].split(".") if s.strip()][got[i].worst_sentence]
    assert (got[900].score, got[900].predicted, got[900].worst_sentence, got[None].score) == (0.0, 0, None, 0.0)
    assert toxicity.score_documents(none, lab.limit(0)).count() == 0
    kept = toxicity.kept_documents(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id is null").count() == 1
    assert toxicity.kept_documents(docs, lab).columns == docs.columns
    assert [r.score for r in toxicity.score_documents(docs, lab.where("toxic = 0")).select("score").distinct().collect()] == [0.0]


def test_all_pairs_above_the_threshold(spark, tmp_path):
    """Components of all pairs with a Jaccard index of 0.8 or more, found whole (recall 1), and none below it."""
    rng = np.random.default_rng(21)
    words = [f"word{i}" for i in range(3000)]
    shared = rng.choice(words, 150).tolist()  # a template that no pair is to be linked by
    rows = [(None, None), (1000, ""), (1001, " \n")]
    for i in range(60):
        base = (shared if i % 3 == 0 else []) + rng.choice(words, int(rng.integers(3, 400))).tolist()
        rows.append((i, " ".join(base)))
        for k in range(int(rng.integers(0, 4))):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, 1 + len(copy) // 22)), False):
                copy[at] = str(rng.choice(words))
            rows.append((100 * (k + 1) + i, " ".join(copy)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    near = [[(not a | b) or len(a & b) * 5 >= 4 * len(a | b) for b in sets] for a in sets]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            label[a] = min(label[b] for b in range(len(rows)) if near[a][b])
    order = lambda k: (rows[k][0] is None, rows[k][0])
    want = {rows[min((k for k in label_of), key=order)][0] for c in set(label) if (label_of := [k for k, x in enumerate(label) if x == c])}
    assert 60 < len(want) < len(rows) - 30
    d = spark.read.parquet(str(tmp_path / "d"))
    assert {r.doc_id for r in simhash.one_of_each_group(d, lanes=1, complete=True).collect()} == want


def test_filters_keep_all_alike_sets():
    """Sizes, places and parities, in the order with frequent hashes last, never part two sets that are alike."""
    rng = np.random.default_rng(31)
    universe = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
    often = np.sort(universe[:80])
    alike = met = 0
    for _ in range(3000):
        a = np.unique(rng.choice(universe, int(rng.integers(1, 120))))
        change = int(rng.integers(0, 2 + len(a) // 6))
        b = np.unique(np.concatenate([rng.permutation(a)[change:], rng.choice(universe, int(rng.integers(0, 1 + change)))]))
        if not len(b) or not simhash.alike(a, b):
            continue
        alike += 1
        one, other = (simhash.first_hashes(x, often).tolist() for x in (a, b))
        common = set(one) & set(other)
        k = min(common)
        both = len(a) + len(b)
        assert min(len(a) - one.index(k), len(b) - other.index(k)) * 9 >= 4 * both
        bits = np.bitwise_count(simhash.parities(a).view(np.uint64) ^ simhash.parities(b).view(np.uint64)).sum()
        assert bits * 9 <= both
        met += change > 0
    assert alike > met > 300


@pytest.mark.parametrize("complete", [False, True])
def test_links_are_verified(spark, tmp_path, complete):
    """Texts with one fingerprint by their many repeats, but few shingles in common, and a chain over such a text."""
    most = "the same three " * 400
    tails = [" ".join(f"{c}{k}" for k in range(12)) for c in "pqr"]
    rows = [(k, most + t) for k, t in enumerate(tails)] + [(10, most.upper() + tails[0])]
    assert len({simhash.fingerprint(t) for _, t in rows}) == 1
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = simhash.one_of_each_group(spark.read.parquet(str(tmp_path / "d")), complete=complete)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2}


def test_rows_keep_their_places(spark, tmp_path):
    """Scans that split the files otherwise after the rows were numbered take no row for another."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    noise = lambda: "".join(rng.choice(letters, 300))
    shared = [noise() for _ in range(10)]
    rows = [(i, f"{i}|" + (shared[i // 2] if i < 20 else noise())) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    split = "spark.sql.files.maxPartitionBytes"
    cost = "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (split, cost)}
    try:
        found = runs_dedup.digests(spark.read.parquet(str(tmp_path / "d")))
        cleaned = runs_dedup.cleaned(spark.read.parquet(str(tmp_path / "d")))
        kept = simhash.one_of_each_group(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set(split, "4kb")
        spark.conf.set(cost, "1b")
        want = sorted((i, *w) for (i, _), w in zip(rows, repeats([t.encode() for _, t in rows], 200), strict=True))
        assert table(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
        assert {r.doc_id for r in cleaned.where("length(text) < 20").collect()} == set(range(20))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_large_group_of_near_copies_is_not_compared_in_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        words = list(base)
        for i in rng.sample(range(150), rng.choice((2, 3, 3, 4))):
            words[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    prints = spark.createDataFrame([(i, [i << 40]) for i in range(300)], "node long, prints array<bigint>")
    compared = []
    verified = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, data: (compared.append(pairs.count()), verified(pairs, data))[1])
    monkeypatch.setattr(simhash, "met_by_prints", lambda *a: spark.createDataFrame([], "a long, b long"))
    found = {r.node: r.component for r in simhash.groups_of(prints, nodes).collect()}
    sets = [simhash.shingle_set(t) for t in texts]
    label = list(range(300))
    for i, j in itertools.combinations(range(300), 2):
        if label[i] != label[j] and simhash.alike(sets[i], sets[j]):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert [found.get(i, i) for i in range(300)] == label
    assert compared[-1] < 300 * 5  # of its last step, in which all pairs that are left are compared


def test_texts_by_key_are_not_shuffled_again(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with common.by_key(spark.range(100).withColumnRenamed("id", "node"), "node", "texts") as texts:
            joined = texts.join(spark.range(50).withColumnRenamed("id", "node"), "node", "left_semi")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 50
            files = texts.inputFiles()
        assert files and not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in files)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

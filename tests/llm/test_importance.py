"""Importance resampling against a plain computation with the standard library's CRC."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import importance

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def ranks_by_hand(rows, target, buckets, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    have = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    want = Counter(bucket(f) for t in target for f in features(t)[1])
    n_have, n_want = have.total() + buckets, want.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * n_have / ((have[b] + 1) * n_want)))
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc, len(words), len(found), weight, score, None])
    long_enough = [r for r in out if r[1] >= min_words]
    long_enough.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, row in enumerate(long_enough[: percent * len(long_enough) // 100], 1):
        row[5] = place
    return sorted(map(tuple, out), key=str)


def got_rows(ranks):
    return sorted((tuple(r) for r in ranks.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 399), st.integers(0, 400)), min_size=1))
def test_crcs_of_spans(data, spans):
    starts = np.array([min(a, len(data)) for a, _ in spans])
    ends = np.array([min(a + n, len(data)) for a, (_, n) in zip(starts.tolist(), spans)])
    got = importance.span_crcs(np.frombuffer(data, dtype=np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def test_crcs_of_spans_of_many_blocks():
    data = np.random.default_rng(2).integers(0, 256, 300_000).astype(np.uint8)
    lengths = [0, 1, 63, 64, 65, 127, 128, 129, 64 * 1023, 64 * 1024, 64 * 1024 + 1, 299_000]
    starts = np.arange(len(lengths)) * 7
    got = importance.span_crcs(data, starts, starts + lengths)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths)]


def test_pieces_of_a_text_give_the_features_of_the_whole(monkeypatch):
    texts = [b"", b" .. ", b"One two-three", b"a" * 90 + b" b " + b"c" * 40, " ünï çödé x".encode() * 30, b"tail"]
    whole = Counter()
    for owner, crcs, _ in importance.features(texts):
        whole.update(zip(owner.tolist(), crcs.tolist()))
    for size in (1, 7, 50):
        monkeypatch.setattr(importance, "PIECE_BYTES", size)
        parts, words = Counter(), Counter()
        for owner, crcs, singles in importance.features(texts):
            parts.update(zip(owner.tolist(), crcs.tolist()))
            words.update(singles.tolist())
        assert parts == whole
        assert words == Counter({i: n for i, t in enumerate(texts) if (n := len(features(t.decode())[0]))})


def test_ranks_equal_brute_force(spark, make_docs, awkward):
    random.seed(9)
    pool = "The quick brown fox Jumps over lazy dogs é漢字 12 x1 ünder".split()
    rows = awkward + [(100 + i, " ".join(random.choices(pool, k=random.randint(0, 30)))) for i in range(150)]
    rows += [(400, rows[-1][1]), (400, rows[-1][1])]
    target = ["quick brown fox", None, "", "lazy dogs lazy dogs", "quick brown fox"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.importance_ranks(make_docs(rows), benchmark, buckets=97, percent=40, min_words=5)
    assert got_rows(got) == ranks_by_hand(rows, target, 97, 40, 5)


def test_production_parameters(spark, make_docs):
    rows = [(i, f"alpha{i % 7} beta gamma{i % 3} " * 10) for i in range(60)]
    benchmark = spark.createDataFrame([(1, "alpha1 beta gamma2 " * 3)], "item_id long, text string")
    got = importance.importance_ranks(make_docs(rows), benchmark)
    assert got_rows(got) == ranks_by_hand(rows, ["alpha1 beta gamma2 " * 3], importance.BUCKETS, importance.PERCENT, importance.MIN_WORDS)
    assert sum(r.rank is not None for r in got.collect()) == 15


def test_what_is_drawn_keeps_all_columns(spark, make_docs):
    rows = [(i, ("good words here " if i < 10 else "other things there ") * 10) for i in range(40)]
    benchmark = spark.createDataFrame([(1, "good words here " * 20)], "item_id long, text string")
    drawn = importance.resampled(make_docs(rows), benchmark)
    assert drawn.columns == make_docs([]).columns and drawn.count() == 10
    assert sum(r.doc_id < 10 for r in drawn.collect()) >= 8


def test_no_documents_and_no_target(spark, make_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.importance_ranks(make_docs([]), empty).collect() == []
    rows = [(1, "a b c"), (2, None)]
    got = importance.importance_ranks(make_docs(rows), empty, buckets=5, percent=100, min_words=1)
    assert got_rows(got) == ranks_by_hand(rows, [], 5, 100, 1)

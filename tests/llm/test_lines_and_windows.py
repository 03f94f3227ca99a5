"""Line deduplication and benchmark windows against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
from corpuslens.llm import decontamination, line_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_by_hand(rows, min_chars, min_docs):
    holders = defaultdict(set)
    key_of = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(doc)
    rank = lambda d: (d is not None, d or 0)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < min_docs or max(holders[key_of(x)], key=rank) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_lines_equal_brute_force(make_docs, awkward):
    random.seed(3)
    pool = [f"{'Shared' if i % 2 else 'shared'} line number {i % 7} " + "é" * (i % 5) for i in range(40)]
    rows = awkward + [(100 + i % 60, "\n".join(random.choice(pool) + random.choice(["", " ", "\t\r"]) for _ in range(i % 9))) for i in range(90)]
    got = line_dedup.deduplicate_lines(make_docs(rows), min_chars=8, min_docs=3)
    assert got.columns == ["id", "text", "n_lines", "n_dropped"]
    assert order(map(tuple, got.collect())) == order(lines_by_hand(rows, 8, 3))


def test_a_line_of_all_documents_spans_partitions(spark, make_docs):
    rows = [(i, f"the one line that every document has\nown {i}") for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r for r in line_dedup.deduplicate_lines(make_docs(rows), min_chars=20).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [i for i, r in got.items() if r.n_dropped == 0] == [1999]
    assert got[7].text == "own 7"


def test_bitmaps_hold_one_bit_per_line(make_docs):
    rows = [(i, "first\n" + "the line they share\n" + "last") for i in range(5)]
    found = {r.id: r for r in line_dedup.keep_bitmaps(make_docs(rows), min_chars=10).collect()}
    assert set(found) == {0, 1, 2, 3}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(found[0].keep), dtype=np.uint8), count=3)
    assert bits.tolist() == [1, 0, 1] and found[0].n_lines == 3 and found[0].n_dropped == 1


def test_no_documents(make_docs):
    assert line_dedup.deduplicate_lines(make_docs([])).collect() == []
    kept = line_dedup.without_shared_lines(make_docs([(1, None)]))
    assert kept.columns == make_docs([]).columns and kept.first().text == ""


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def hits_by_hand(rows, items, size):
    out = set()
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            target = words(passage)
            n = min(size, len(target))
            windows = {tuple(target[i : i + n]) for i in range(len(target) - n + 1)} if n else set()
            for i in range(len(own) - n + 1) if n else ():
                if tuple(own[i : i + n]) in windows and item is not None:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.add((doc, len(own), len(hit), tuple(sorted(found))))
    return out


def test_windows_equal_brute_force(spark, make_docs, awkward):
    random.seed(5)
    vocabulary = ["The", "of", "a", "b1", "ñandú", "Zeta", "x"]
    passages = [" ".join(random.choices(vocabulary, k=random.randint(0, 9))) for _ in range(30)]
    items = [(i // 2, p) for i, p in enumerate(passages)] + [(None, "one two three"), (99, None), (100, "漢字"), (7, "the of")]
    rows = awkward + [(200 + i, ", ".join(random.choices(vocabulary + passages, k=12))) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for few in (200_000, 0):  # the broadcast and the shuffled form
        got = decontamination.benchmark_hits(make_docs(rows), benchmark, window_words=4, broadcast_windows=few)
        assert {(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()} == hits_by_hand(rows, items, 4)


def test_contaminated_rows_go_and_clean_ones_stay(spark, make_docs):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, passage), (2, passage + " more" * 300), (3, "clean"), (4, None)]
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontamination.clean_documents(make_docs(rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == make_docs([]).columns
    assert decontamination.benchmark_hits(make_docs(rows), benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_no_python_on_the_main_path(make_docs, spark):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontamination.benchmark_hits(make_docs([(1, "a b c")]), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

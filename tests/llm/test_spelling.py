"""Spelling variants against a plain all-pairs computation."""

import random
import re
import zlib
from collections import Counter

import pytest
from corpuslens.llm import spelling
from pyspark.sql import functions as F

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_by_hand(rows, min_chars, min_count, divisor):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_chars and n >= min_count}


def groups_by_hand(words, ratio):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))))
    return sorted(out)


def grouped(words):
    return sorted(map(tuple, words.collect()))


@pytest.mark.parametrize("shortest", [1, 4, 6])
def test_groups_equal_all_pairs(spark, shortest):
    random.seed(shortest)
    words = {}
    for _ in range(120):
        word = "".join(random.choices("abé", k=random.randint(shortest, shortest + 3)))
        words[word] = random.choice([1, 2, 5, 25, 125, 700, 700, 4000])
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert grouped(spelling.group_variants(table)) == groups_by_hand(words, 5)
    assert grouped(spelling.group_variants(table, ratio=1.5)) == groups_by_hand(words, 1.5)


def test_words_of_one_ending_do_not_meet(spark):
    """A chunk that very many words share is no key by itself."""
    words = {f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}xyzuvw": 1 for i in range(3000)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling.near_pairs(table)
    pairs.collect()
    want = {tuple(sorted((a, b))) for a in list(words)[:40] for b in words if one_edit(a, b)}
    got = {(r.word, r.near) for r in pairs.collect()}
    assert want <= got and all(one_edit(a, b) for a, b in got)
    keys = table.withColumn("chars", F.char_length("word")).select(F.inline(spelling._keys(F.col("word"), F.col("chars"), 0)))
    assert keys.groupBy("size", "place", "letters").count().agg({"count": "max"}).first()[0] <= 26 * 26


def test_chains_of_forms_end_at_the_root(spark):
    chain = {"abcdef"[:i] + "X" * (6 - i) + "tail": 5**i for i in range(7)}
    table = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = grouped(spelling.group_variants(table))
    assert got == groups_by_hand(chain, 5) and {r[2] for r in got} == {"abcdeftail"}


def test_words_of_texts(make_docs, awkward):
    random.seed(4)
    pool = ["Colour", "color", "COLOURS", "naïveté", "straße×÷ÿ", "abc", "Ünïcode", "mısspell", "occurrence", "ocurrence", "x" * 50]
    rows = awkward + [(20 + i % 70, " ".join(random.choices(pool, k=30)) + random.choice("-_1\n") + "end") for i in range(120)]
    docs = make_docs(rows)
    for options in ({}, {"min_chars": 3, "min_count": 2, "divisor": 3}, {"divisor": 1}):
        want = counts_by_hand(rows, options.get("min_chars", 6), options.get("min_count", 5), options.get("divisor", 199))
        assert {r.word: r.n for r in spelling.word_counts(docs, **options).collect()} == want
    got = spelling.spelling_variants(docs, min_chars=4, divisor=5)
    assert grouped(got) == groups_by_hand(counts_by_hand(rows, 4, 5, 5), 5)


def test_counts_handed_on_early_are_the_same(make_docs, monkeypatch):
    rows = [(i, "alphabet soup kitchen sinks " * 3) for i in range(30)]
    monkeypatch.setattr(spelling, "WORDS_HELD", 0)
    assert {r.word: r.n for r in spelling.word_counts(make_docs(rows)).collect()} == counts_by_hand(rows, 6, 5, 199)


def test_no_words(spark, make_docs):
    assert spelling.spelling_variants(make_docs([])).collect() == []
    assert spelling.spelling_variants(make_docs([(1, None), (2, "")])).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)

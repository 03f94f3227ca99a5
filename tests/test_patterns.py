"""Pattern tables against plain regular expressions, and the literals that patterns need."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from corpuslens.operators import patterns as pt


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("AKIA[0-9A-Z]{16}", ["akia"]),
        ("(?:abc|de)+x", ["abc", "de"]),
        ("ab(c)d", ["abcd"]),
        (r"foo\.bar$", ["foo.bar"]),
        ("(?i)Token", ["token"]),
        ("a{2,}bcd?", ["bc"]),
        ("[0-9]+", None),
        ("x*", None),
        ("(abc)?", None),
        ("abc|", None),
        ("[.]img$", [".img"]),
        ("^system.*[.]img", ["system"]),
        (r"\Qa.b\E", None),  # not read as Java reads it
        ("[[abc]]xyz", None),
        ("[a&&b]xyz", None),
        ("[]a]xyz", None),
        (r"\x41bcd", None),
        ("(?iu)kelvin", None),
        ("(", None),
        ("äöü", None),
        ("straße", ["stra"]),
        ("(?=abc)def", ["def"]),
        ("(?!abc)de", ["de"]),
        ("(?x) a b c", None),
    ],
)
def test_required_literals(pattern, literals):
    assert pt.required_literals(pattern) == literals


atoms = st.sampled_from(["a", "b", "ab", "[ab]", ".", "a?", "b*", "(?:ab)+", "(a|b)", "(?:a|bb)", "a{2}", "^", "$", r"\b", "(?i:B)", "(?:ab|)"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(atoms, max_size=5).map("".join), min_size=1, max_size=3).map("|".join), st.text("aAbB c", max_size=8))
def test_every_match_holds_a_literal(pattern, text):
    found, literals = re.search(pattern, text), pt.required_literals(pattern)
    if found and literals is not None:
        assert any(x in text.lower() for x in literals)


def by_hand(texts, patterns):
    return sorted((i, k) for i, t in texts for k, p in patterns if t is not None and p is not None and re.search(p, t))


def pairs(found):
    return sorted((r.id, r.rule) for r in found.select("id", "rule").collect())


def tables(spark, texts, patterns):
    return (
        spark.createDataFrame(texts, "id int, text string").repartition(3),
        spark.createDataFrame(patterns, "rule string, pattern string"),
    )


def test_matches_equal_every_pattern_on_every_text(spark, monkeypatch):
    random.seed(8)
    words = ["alpha", "Beta", "gam.ma", "delta42", "ÄÖ", "\n", "", "x", "AKIA1234", "token = 7"]
    texts = [(i, " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(200)] + [(900, None), (901, "")]
    texts.append((902, "filler " * 3000 + "delta42 AKIA9"))
    patterns = [
        ("a", "alpha|delta[0-9]+"), ("b", "(?i)BETA x"), ("c", r"gam\.ma"), ("d", "[0-9]{4}"), ("e", "AKIA[0-9]+$"), ("f", "a.*Ä"),
        ("g", None), ("h", "nowhere"), ("i", "x$"), ("j", "^$"), ("k", "token = [0-9]|AKIA1"), ("l", r"\bx\b"), ("m", "Ö"), ("m", "Ö"),
    ]
    for step in (1 << 20, 64):
        monkeypatch.setattr(pt, "STEP_BYTES", step)
        table, rules = tables(spark, texts, patterns)
        assert pairs(pt.matches(table, "text", rules, "pattern")) == by_hand(texts, patterns)
        only = [p for p in patterns if p[0] in "ach"]
        assert pairs(pt.matches(table, "text", rules.where("rule IN ('a', 'c', 'h')"), "pattern")) == by_hand(texts, only)


def test_findings_are_all_places(spark):
    texts, rules = tables(spark, [(1, "ab1 ab22 AB3"), (2, "none")], [("r", "ab[0-9]+"), ("s", "(?i)AB(?=3)")])
    found = pt.findings(texts, "id", "text", rules, "rule", "pattern").collect()
    assert sorted(map(tuple, found)) == [(1, "r", "ab1"), (1, "r", "ab22"), (1, "s", "AB")]


def test_no_patterns_and_no_texts(spark):
    texts, rules = tables(spark, [(1, "abc")], [("r", "abc")])
    assert pt.matches(texts, "text", rules.limit(0), "pattern").collect() == []
    assert pt.matches(texts.limit(0), "text", rules, "pattern").collect() == []


def test_candidates_hold_the_literal(spark):
    texts, rules = tables(spark, [(1, "one two"), (2, "two Three"), (3, "3")], [("r", "one.*"), ("s", "three|one"), ("t", "[0-9]")])
    assert pairs(pt.candidates(texts, "text", rules, "pattern")) == [(1, "r"), (1, "s"), (1, "t"), (2, "s"), (2, "t"), (3, "t")]
    plan = pt.candidates(texts, "text", rules, "pattern")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan

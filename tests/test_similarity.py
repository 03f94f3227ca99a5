import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import fuzzy
from corpuslens.operators import similarity as sim
from corpuslens.operators.similarity_store import SimilarityStore


def plain_digest(data: bytes) -> str:
    """The published algorithm, one byte at a time."""

    def run(block):
        window, h1, h2, h3 = [0] * 7, 0, 0, 0
        a = b = 0x28021967
        one = two = last_one = last_two = ""
        for n, c in enumerate(data):
            h2 = (h2 - h1 + 7 * c) & 0xFFFFFFFF
            h1 = (h1 + c - window[n % 7]) & 0xFFFFFFFF
            window[n % 7] = c
            h3 = ((h3 << 5) & 0xFFFFFFFF) ^ c
            rolling = (h1 + h2 + h3) & 0xFFFFFFFF
            a = (a * 0x01000193 & 0xFFFFFFFF) ^ c
            b = (b * 0x01000193 & 0xFFFFFFFF) ^ c
            if rolling % block == block - 1:
                last_one = fuzzy.ALPHABET[a % 64]
                if len(one) < 63:
                    one, a, last_one = one + last_one, 0x28021967, ""
            if rolling % (2 * block) == 2 * block - 1:
                last_two = fuzzy.ALPHABET[b % 64]
                if len(two) < 31:
                    two, b, last_two = two + last_two, 0x28021967, ""
        pieces = len(one)
        if rolling:
            last_one, last_two = fuzzy.ALPHABET[a % 64], fuzzy.ALPHABET[b % 64]
        return one + last_one, two + last_two, pieces

    block = 3
    while block * 64 < len(data):
        block *= 2
    one, two, pieces = run(block)
    while block > 3 and pieces < 32:
        block //= 2
        one, two, pieces = run(block)
    return f"{block}:{one}:{two}"


@pytest.mark.parametrize("size", [1, 6, 7, 60, 700, 5000])
def test_piecewise_digest_equals_plain_form(size):
    rng = random.Random(size)
    for pick in (lambda: rng.randrange(256), lambda: rng.choice(b"ab cd\n"), lambda: 0):
        data = bytes(pick() for _ in range(size))
        assert fuzzy.piecewise_digest(data) == plain_digest(data)


def test_scores():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(6000))
    near = data[:3000] + b"changed" + data[3000:]
    far = bytes(rng.randrange(256) for _ in range(6000))
    a, b, c = map(fuzzy.piecewise_digest, (data, near, far))
    assert fuzzy.piecewise_score(a, a) == 100
    assert fuzzy.piecewise_score(a, b) == fuzzy.piecewise_score(b, a) > 80
    assert fuzzy.piecewise_score(a, c) == 0
    ta, tb, tc = map(fuzzy.tlsh_value, (data, near, far))
    assert fuzzy.tlsh_distance(ta, ta) == 0
    assert fuzzy.tlsh_distance(ta, tb) == fuzzy.tlsh_distance(tb, ta) < 40 < fuzzy.tlsh_distance(ta, tc)
    assert fuzzy.tlsh_value(b"short") is None
    assert sorted(fuzzy.TLSH_PERMUTATION) == list(range(256))


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in families of near copies, exact copies, and texts of their own."""
    rng = random.Random(5)
    rows = []
    for family in range(4):
        base = [rng.choice(["alpha", "beta", "gamma", "delta", "word%d" % rng.randrange(400)]) for _ in range(900)]
        for _ in range(6):
            changed = list(base)
            for _ in range(rng.randrange(0, 25)):
                changed[rng.randrange(len(changed))] = "x%d" % rng.randrange(1000)
            rows.append((len(rows), " ".join(changed)))
    rows.extend((len(rows) + i, rows[i][1]) for i in range(3))
    rows.extend((100 + i, " ".join("own%d" % rng.randrange(10**6) for _ in range(500))) for i in range(4))
    df = spark.createDataFrame(rows, "id long, text string")
    digests = sim.fuzzy_digests(df, "id", "text").select("id", "digest").checkpoint()
    return rows, digests, sim.digest_nodes(digests, "id").checkpoint()


@pytest.mark.parametrize("cell_rows", [2, 2000])
def test_edges_equal_brute_force(corpus, cell_rows):
    _, _, nodes = corpus
    listed = [(r["node"], r["digest"]) for r in nodes.collect()]
    expected = {}
    for a, da in listed:
        for b, db in listed:
            if a < b and (score := fuzzy.piecewise_score(da, db)) > 0:
                expected[a, b] = score
    found = {(r["src"], r["dst"]): r["score"] for r in sim.similarity_edges(nodes, cell_rows).collect()}
    assert found == expected and len(expected) > 20


def brute_groups(nodes, matches):
    groups = []
    for node in sorted(nodes):
        joined = False
        for group in groups:
            if all(frozenset((node, member)) in matches for member in group):
                group.append(node)
                joined = True
        if not joined:
            groups.append([node])
    return {(group[0], member) for group in groups for member in group}


def test_groups_equal_greedy_order(spark):
    rng = random.Random(11)
    for share in (0.15, 0.5, 0.9):
        names = list(range(1, 15))
        pairs = [(a, b) for a in names for b in names if a < b and rng.random() < share]
        nodes = spark.createDataFrame([(n,) for n in names], "node long")
        edges = spark.createDataFrame(pairs or [(0, 0)], "src long, dst long")
        found = {tuple(r) for r in sim.similarity_groups(nodes, edges).collect()}
        assert found == brute_groups(names, {frozenset(p) for p in pairs})


def count_rounds(monkeypatch):
    rounds = []
    settled = sim._settled_places
    monkeypatch.setattr(sim, "_settled_places", lambda *a: rounds.append(1) or settled(*a))
    return rounds


def test_a_large_clique_takes_few_rounds(spark, monkeypatch):
    rounds = count_rounds(monkeypatch)
    nodes = spark.range(1, 701).select(F.col("id").alias("node"))
    edges = nodes.toDF("src").join(nodes.toDF("dst"), F.col("src") < F.col("dst")).where("NOT (src = 5 AND dst = 600)")
    found = {tuple(r) for r in sim.similarity_groups(nodes, edges).collect()}
    assert found == {(1, n) for n in range(1, 701) if n != 600} | {(600, n) for n in range(600, 701)}
    assert len(rounds) <= 4


def test_another_order_shortens_chains(spark, monkeypatch):
    rng = random.Random(3)
    names = list(range(1, 61))
    pairs = [(n, n + 1) for n in names[:-1]]
    hashes = {n: rng.random() for n in names}
    nodes = spark.createDataFrame([(n, hashes[n]) for n in names], "node long, hash double")
    rounds = count_rounds(monkeypatch)
    found = {tuple(r) for r in sim.similarity_groups(nodes, spark.createDataFrame(pairs, "src long, dst long"), "hash").collect()}
    rank = {n: i for i, n in enumerate(sorted(names, key=hashes.get))}
    back = {i: n for n, i in rank.items()}
    want = brute_groups(range(60), {frozenset((rank[a], rank[b])) for a, b in pairs})
    assert found == {(back[g], back[n]) for g, n in want} and len(rounds) <= 8


def test_groups_of_corpus_match_pairwise(corpus):
    _, _, nodes = corpus
    edges = sim.similarity_edges(nodes).checkpoint()
    matches = {frozenset((r["src"], r["dst"])) for r in edges.collect()}
    found = {tuple(r) for r in sim.similarity_groups(nodes, edges).collect()}
    assert found == brute_groups([r["node"] for r in nodes.collect()], matches)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    expected = {n: root(n) for n in list(parent)}
    found = {r["node"]: r["component"] for r in sim.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == expected


def test_adjacency_is_symmetric_and_copies_share_a_node(corpus):
    rows, digests, nodes = corpus
    edges = sim.similarity_edges(nodes)
    both = {(r["src"], r["dst"]) for r in sim.adjacency(edges).collect()}
    assert both == {(b, a) for a, b in both}
    members = {r["id"]: r["node"] for r in sim.members_of(digests, nodes, "id").collect()}
    texts = dict(rows)
    assert all(members[a] == members[b] for a in texts for b in texts if texts[a] == texts[b])


def test_hot_chunk_is_split(spark):
    """A key that all nodes share still gives every pair, from cells of bounded size."""
    nodes = spark.range(60).select(F.col("id").alias("node"))
    rows = sim.postings(nodes, F.array(F.lit(7).cast("long"), (F.col("node") % 3 + 100).cast("long")))
    found = sorted(tuple(r) for r in sim.candidate_pairs(rows, cell_rows=10).collect())
    assert found == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def stored_pairs(spark, tmp_path, steps, **options):
    store = SimilarityStore(spark, str(tmp_path), **options)
    for rows in steps:
        store.add(spark.createDataFrame(rows, "id long, digest string"), "id")
    return store


def test_steps_equal_one_run(spark, corpus, tmp_path):
    rows, digests, nodes = corpus
    listed = [(r["id"], r["digest"]) for r in digests.collect()]
    changed = [(i, listed[(n + 7) % len(listed)][1]) for n, (i, _) in enumerate(listed[:5])]
    steps = [changed + listed[5:20], listed[20:] + [(10_000, listed[3][1])], listed[:5] + [(10_000, None)]]
    store = stored_pairs(spark, tmp_path / "steps", steps)
    name = {r["node"]: r["digest"] for r in nodes.collect()}
    want = {tuple(sorted((name[r["src"]], name[r["dst"]]))) + (r["score"],) for r in sim.similarity_edges(nodes).collect()}
    assert {tuple(r) for r in store.edges().collect()} == want and len(want) > 20
    assert {tuple(r) for r in store.members().collect()} == set(listed)
    store.compact()
    assert len(store.steps()) == 1 and {tuple(r) for r in store.edges().collect()} == want
    store.add(spark.createDataFrame([(i, None) for i, _ in listed], "id long, digest string"), "id")
    assert store.edges().collect() == [] and store.members().collect() == []


def test_what_is_stored_is_not_compared_again(spark, tmp_path):
    def score(a, b):
        @F.pandas_udf("int")
        def one(x: pd.Series, y: pd.Series) -> pd.Series:
            with open(tmp_path / "compared", "a") as log:
                log.writelines(f"{p} {q}\n" for p, q in zip(x, y))
            return pd.Series([1] * len(x))

        return one(a, b)

    keys = lambda d: F.array(F.length(d).cast("long"))
    store = stored_pairs(spark, tmp_path / "s", [[(1, "aa"), (2, "bb"), (3, "ccc")], [(4, "dd"), (5, "ee"), (6, "aa")], [(7, "bb")]], keys=keys, score=score)
    compared = [tuple(line.split()) for line in (tmp_path / "compared").read_text().splitlines()]
    assert sorted(compared) == sorted(itertools.combinations(["aa", "bb", "dd", "ee"], 2))
    assert {(r.src, r.dst) for r in store.edges().collect()} == set(compared)


def test_a_step_that_dies_can_run_again(spark, tmp_path, monkeypatch):
    keys, one = (lambda d: F.array(F.length(d).cast("long"))), (lambda a, b: F.lit(1))
    store = stored_pairs(spark, tmp_path, [[(1, "aa")]], keys=keys, score=one)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add(spark.createDataFrame([(2, "bb")], "id long, digest string"), "id")
    assert store.edges().collect() == [] and len(store.steps()) == 1
    store.add(spark.createDataFrame([(2, "bb"), (3, "")], "id long, digest string"), "id")
    assert [tuple(r) for r in store.edges().collect()] == [("aa", "bb", 1)]

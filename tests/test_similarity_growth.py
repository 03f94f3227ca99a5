"""Signatures and chunks in batches, and what links cost."""

import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_similarity import plain_digest

from corpuslens.functions import digests as dg
from corpuslens.functions import fuzzy
from corpuslens.operators import similarity as sim
from corpuslens.operators.similarity_store import SimilarityStore
from corpuslens.plans import similarity_queries as sq

ODD = ["", None, "abcdef", "abcdefg", "abcdefgabcdefgabcdefg", "AAAAAAAAAA", "+/+/+/+/zZ9", "0123456789abcdef" * 40]


def test_chunks_in_batches_equal_chunks_one_by_one(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "id long, s string").repartition(2)
    found = rows.select("id", dg.chunk_set("s").alias("got"), F.transform(F.array("s"), dg._chunks)[0].alias("want")).collect()
    assert len(found) == len(ODD) and all(r.got == r.want for r in found)
    assert "ArrowEvalPython" in rows.select(dg.chunk_set("s"))._jdf.queryExecution().executedPlan().toString()


def test_word_signature(spark):
    texts = [None, "", "  ", "one", " one\ttwo three four\x0bfive\x1csix ", "wörter und 文字\n\r\f😀"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    words = F.regexp_extract_all("t", F.lit(r"\S+"), 0)
    plain = F.array_join(F.transform(words, lambda w: F.substring(F.md5(w), 1, 1)), "")
    for r in rows.select("t", sq.word_signature("t").alias("got"), plain.alias("want")).collect():
        assert r.got == r.want, r.t
    assert rows.where("id = 3").select(sq.word_signature("t")).first()[0] == hashlib.md5(b"one").hexdigest()[0]


def test_few_words_are_remembered():
    digits = sq._Digits()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sq, "_KNOWN_WORDS", 10)
        assert [digits[str(i)] for i in range(100)] == [hashlib.md5(str(i).encode()).hexdigest()[0] for i in range(100)]
    assert len(digits) <= 10


def test_postings_are_dealt_out_once(spark):
    """Every node links to the lowest node of each of its keys, with one exchange of the rows and one of the links."""
    rows = spark.range(3000).select((F.col("id") % 97).alias("node"), (F.col("id") % 31).alias("key")).union(spark.range(200).select(F.col("id"), F.lit(5).alias("key")))
    links = sim.candidate_links(rows)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2 and "ExistingRDD" not in plan
    lowest, held = {}, rows.collect()
    for node, key in held:
        lowest[key] = min(node, lowest.get(key, node))
    found = [tuple(r) for r in links.collect()]
    assert set(found) == {(lowest[k], n) for n, k in held if n > lowest[k]} and len(found) == len(set(found))


def pairs_by_hand(fresh, known=()):
    every = [*fresh, *known]
    return sorted({(min(a, b), max(a, b)) for a, x in fresh for b, y in every if a != b and set(x) & set(y)})


def as_nodes(spark, rows):
    return spark.createDataFrame(rows, "node long, keys array<long>")


@pytest.mark.parametrize("cell_rows", [3, 2000])
def test_pairs_of_keys_in_any_order(spark, cell_rows):
    """Passages in other orders, repeated and cut: every pair is there, also with nodes known before."""
    rng = random.Random(7)
    passages = [[p * 10 + i for i in range(rng.randrange(1, 9))] for p in range(25)]
    rows = []
    for n in range(60):
        keys = [k for p in rng.sample(passages, rng.randrange(0, 4)) for k in p[rng.randrange(0, 2) :]]
        rows.append((n * 3, list(dict.fromkeys(rng.sample(keys, len(keys)) if n % 5 == 0 else keys))))
    known, fresh = rows[:35], rows[35:]
    postings = [sim.postings(as_nodes(spark, part), "keys") for part in (rows, fresh, known)]
    assert sorted(tuple(r) for r in sim.candidate_pairs(postings[0], cell_rows).collect()) == pairs_by_hand(rows)
    assert sorted(tuple(r) for r in sim.candidate_pairs(postings[1], cell_rows, postings[2]).collect()) == pairs_by_hand(fresh, known)


def test_a_shared_passage_gives_a_pair_once(spark, monkeypatch):
    """What is shuffled to find the distinct pairs: one row per pair, not one per key of a passage."""
    rows = sim.postings(spark.range(40).select(F.col("id").alias("node"), F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long")).alias("keys")), "keys")
    made, distinct = [], type(rows).distinct
    monkeypatch.setattr(type(rows), "distinct", lambda df: made.append(df.count()) or distinct(df))
    assert sim.candidate_pairs(rows).count() == 780 and made == [780]


def test_stored_edges_do_not_hold_digests(spark, tmp_path):
    digests = [f"{n:03d}" * 3000 for n in range(60)]
    store = SimilarityStore(spark, str(tmp_path / "s"), keys=lambda d: F.array(F.lit(1).cast("long")), score=None)
    for part in (0, 1):
        store.add(spark.createDataFrame(list(enumerate(digests))[part * 30 : part * 30 + 30], "id long, digest string"), "id")
    for step in store.steps():
        kinds = dict(spark.read.parquet(str(tmp_path / "s" / step / "edges")).dtypes)
        assert (kinds["src"], kinds["dst"]) == ("bigint", "bigint")
    assert store.edges().count() == 60 * 59 // 2
    names = store.members().groupBy("digest").agg(F.min("file_id").alias("name")).where("name < 10")
    assert sorted((r.src, r.dst) for r in store.edges(names).collect()) == list(itertools.combinations(range(10), 2))


@pytest.mark.parametrize("block", [3, 16])
def test_groups_block_by_block(spark, monkeypatch, block):
    """Blocks of few nodes give the groups of the order of nodes, in as many rounds as there are blocks, also along a path."""
    monkeypatch.setattr(sim, "BLOCK_NODES", block)
    rounds, settled = [], sim._settled_places
    monkeypatch.setattr(sim, "_settled_places", lambda *a: rounds.append(1) or settled(*a))
    rng = random.Random(block)
    pairs = {(n * 5, n * 5 + 5) for n in range(15)} | {(a * 5, b * 5) for a in range(16, 40) for b in range(a + 1, 40) if rng.random() < 0.7}
    groups = []
    for node in range(0, 205, 5):
        fits = [g for g in groups if all((m, node) in pairs for m in g)]
        for g in fits:
            g.append(node)
        if not fits:
            groups.append([node])
    nodes = spark.createDataFrame([(n,) for n in range(0, 205, 5)], "node long")
    found = sorted(tuple(r) for r in sim.similarity_groups(nodes, spark.createDataFrame(sorted(pairs), "src long, dst long")).collect())
    assert found == sorted((g[0], m) for g in groups for m in g)
    assert len(rounds) == -(-len({b for _, b in pairs}) // block)


def test_digests_together_equal_digests_alone(monkeypatch):
    rng = random.Random(4)
    texts = [None, b"", b"a", b"\0" * 9, b"ab" * 3000, *(bytes(rng.choice(b"ab cd\n\0") for _ in range(rng.randrange(1, 1500))) for _ in range(60))]
    texts += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 4000))) + bytes(rng.randrange(9)) for _ in range(40)]
    want = [None if t is None else plain_digest(t) if t else "3::" for t in texts]
    for together, long in ((1, 1), (3000, 40), (1 << 20, 512)):
        monkeypatch.setattr(fuzzy, "TOGETHER_BYTES", together)
        monkeypatch.setattr(fuzzy, "LONG_PIECE", long)
        assert fuzzy.piecewise_digests(iter(texts)) == want


def digest_like(rng, letters="abcdefgh"):
    def part(most):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(0, most)))

    return f"{3 << rng.randrange(5)}:{part(65)}:{part(33)}"


def test_scores_of_many_pairs_equal_single_scores():
    rng = random.Random(6)
    listed = [digest_like(rng, letters) for letters in ("ab", "abcd", fuzzy.ALPHABET) for _ in range(150)]
    for digest in listed[:300]:
        block, first, second = digest.split(":")
        at = rng.randrange(len(first) + 1)
        listed += [f"{block}:{first[:at]}Q{first[at + 2 :]}"[:60] + f":{second}", f"{int(block) * 2}:{second}ZZ:{first[:30]}"]
    listed += ["3:wörterwörterxx:ab", "3:wörterwörteryy:ab", "3:" + "abcdefgh" * 20 + ":a", "6:aaaaaaaaaabcdefg:x", "6:aaaabcdefg:x"]
    pairs = [(a, b) for a in listed for b in rng.sample(listed, 12)] + [(a, a) for a in listed] + [(listed[i], listed[i + 1]) for i in range(len(listed) - 1)]
    want = [fuzzy.piecewise_score(a, b) for a, b in pairs]
    found = fuzzy.piecewise_scores(pa.array([a for a, _ in pairs] + ["3::", None]), pa.array([b for _, b in pairs] + [None, None])).to_pylist()
    assert found == [*want, None, None] and len({*want}) > 40


def test_chunks_of_many_signatures(monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "abcdef", "ab:cdefghi", "0123456789abcdef" * 40, *("".join(rng.choice("abC+") for _ in range(rng.randrange(0, 60))) for _ in range(200))]
    alone = [dg.chunk_numbers([t])[0].tolist() for t in texts]
    assert alone[:4] == [[], [], [], []] and all(len(x) == len(set(x)) for x in alone)
    monkeypatch.setattr(dg, "TOGETHER_CHARS", 300)
    chunks, many = dg.chunk_numbers(iter(texts))
    assert many.tolist() == [len(x) for x in alone] and chunks.tolist() == [c for x in alone for c in x]


@pytest.mark.parametrize("cell_rows", [2, 7, 2000])
def test_pairs_are_scored_where_they_are_made(spark, monkeypatch, cell_rows):
    """Cells that go on in other batches, more pairs than are held, more tasks than cores: every pair once, with its score."""
    rng = random.Random(cell_rows)
    base = ["".join(rng.choice(fuzzy.ALPHABET) for _ in range(60)) for _ in range(4)]
    digests = set()
    while len(digests) < 70:
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(fuzzy.ALPHABET)
        digests.add(f"{rng.choice([48, 96])}:{''.join(text)}:{''.join(text[::-2])}")
    names = dict(zip(rng.sample(range(1000), len(digests)), sorted(digests)))
    want = {(a, b): s for a in names for b in names if a < b and (s := fuzzy.piecewise_score(names[a], names[b])) > 0}
    monkeypatch.setattr(sim, "PAIRS_HELD", 5)
    monkeypatch.setattr(sim, "PAIRS_OF_TASK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        nodes = spark.createDataFrame(list(names.items()), "node long, digest string").checkpoint()
        edges = sim.similarity_edges(nodes, cell_rows)
        found = [tuple(r) for r in edges.collect()]
        strings = sim.similarity_edges(nodes.withColumn("node", F.lpad(F.col("node").cast("string"), 4, "0")), cell_rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(want) > 200 and {(a, b): s for a, b, s in found} == want
    assert sorted((int(r.src), int(r.dst), r.score) for r in strings) == sorted(found)


def test_digests_go_with_postings_and_not_with_pairs(spark):
    nodes = spark.createDataFrame([(n, f"48:{'abcdefghijklmnop' * 3}{n:03d}:xyz") for n in range(50)], "node long, digest string").checkpoint()
    edges = sim.similarity_edges(nodes)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert "Join" not in above and below.count("Join") == 1 and edges.count() == 50 * 49 // 2


def test_keys_within_a_passage_are_left_out(spark):
    rows = sim.postings(spark.range(40).select(F.col("id").alias("node"), F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long")).alias("keys")), "keys")
    assert sim._begun(rows.withColumn("fresh", F.lit(True)), 2000).select("key").distinct().count() == 1

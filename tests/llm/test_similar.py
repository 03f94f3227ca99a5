"""Vector links, the n-gram join and repeated byte strings against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import common, ngram_join, suffix_dedup, vector_caps
from corpuslens.llm.common import Fingerprints, mixed


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_vectors_equal_brute_force(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 32))
    vectors = [c + random.normal(size=32) * scale for c in centres for scale in (0, 0.05, 0.15, 0.2, 0.3)]
    vectors += [random.normal(size=32) for _ in range(200)] + [centres[0]] * 30 + [centres[1] * 7.5, centres[1] * 1e-200]
    # One crowd, larger than a slice.
    vectors += [centres[2] + random.normal(size=32) * 0.08 for _ in range(700)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [None, [0.0] * 32, [1.0] * 31 + [None], [1.0] * 31 + [float("nan")], [1.0] * 31 + [float("inf")], []]
    rows += [(10_000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS node", "3 AS filter")
    got = {r.id: (r.n_links, r.component_id) for r in vector_caps.vector_links(df).collect()}
    unit = np.array(vectors)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b]
    found = components(range(len(vectors)), links)
    assert len(got) == len(rows)
    recall = sum(got[i][0] for i in range(len(vectors))) / near.sum()
    assert 0.995 <= recall <= 1.0
    exact = sum(got[i] == (int(near[i].sum()), found[i]) for i in range(len(vectors)))
    assert exact >= 0.97 * len(vectors)
    assert all(got[10_000 + i] == (0, 10_000 + i) for i in range(len(bad)))


def test_list_decoding_finds_every_filter():
    code = vector_caps.ProductCode(24, 5000, parts=3)
    vectors = np.random.default_rng(2).normal(size=(50, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    row, name = code.filters_of(vectors)
    a, b, c = code._products(vectors)
    total = a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]
    want = np.argwhere(total.reshape(50, -1) >= code.threshold)
    assert sorted(zip(row.tolist(), name.tolist())) == sorted(map(tuple, want.tolist()))


def test_every_vector_has_filters_and_pairs_meet():
    """The code of a million vectors: no vector is without filters, few pairs at the least cosine are missed."""
    random = np.random.default_rng(3)
    for dimension in (32, 96):
        code = vector_caps.Codes(dimension, 1_000_000)
        a, b = random.normal(size=(2, 1500, dimension))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        held = []
        for vectors in (a, b):
            found = [code.filters_of(vectors[start : start + 100]) for start in range(0, len(vectors), 100)]
            held.append([set(name[row == i].tolist()) for row, name in found for i in range(100)])
        assert min(len(f) for side in held for f in side) >= len(code.codes) * code.best
        assert sum(x.isdisjoint(y) for x, y in zip(*held)) <= 0.003 * len(a)


def test_best_directions():
    code = vector_caps.ProductCode(24, 5000, parts=3)
    vectors = np.random.default_rng(2).normal(size=(50, 24))
    a, b, c = code._products(vectors)
    total = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(50, -1)
    assert np.array_equal(np.sort(code.best_of(vectors, 9), axis=1), np.sort(np.argsort(-total, axis=1)[:, :9], axis=1))


def test_few_vectors_are_compared_in_full_and_many_by_codes(spark):
    random = np.random.default_rng(5)
    centres = random.normal(size=(300, 24))
    vectors = np.concatenate([centres, centres + random.normal(size=centres.shape) * 0.27])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for exact, least in ((4_096, 1.0), (vector_caps.EXACT, 0.995)):
        got = {r.id: r.n_links for r in vector_caps.vector_links(df, exact=exact).collect()}
        assert all(got[i] <= near[i].sum() for i in got) and sum(got.values()) >= least * near.sum()


def test_vectors_of_every_length_are_compared(spark):
    random = np.random.default_rng(6)
    rows, want = [], {}
    for length in (1, 7, 24, 32):
        centres = random.normal(size=(60, length))
        vectors = np.concatenate([centres, centres + random.normal(size=centres.shape) * 0.2, centres[:5]])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.95
        np.fill_diagonal(near, False)
        links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b]
        found, base = components(range(len(vectors)), links), 1000 * length
        rows += [(base + i, v.tolist()) for i, v in enumerate(vectors)]
        want |= {base + i: (int(near[i].sum()), base + found[i]) for i in range(len(vectors))}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {r.id: (r.n_links, r.component_id) for r in vector_caps.vector_links(df, exact=4_096).collect()} == want
    # With codes for every length, too.
    got = {r.id: r.n_links for r in vector_caps.vector_links(df).collect()}
    assert all(got[i] <= want[i][0] for i in want)
    for length in (7, 24, 32):
        own = [i for i in want if i // 1000 == length]
        assert sum(got[i] for i in own) >= 0.99 * sum(want[i][0] for i in own)


def test_tables_of_every_size_go_through_codes():
    assert all(vector_caps.Codes(16, nodes).codes for nodes in (1, 2, 5, 500))
    with pytest.warns(UserWarning, match="all pairs"):
        # One filter for each vector and code is too few: then all pairs are compared.
        assert vector_caps.Codes(48, 10**6, min_cosine=0.3, best=1, filters=0.01).codes == []


def test_vectors_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_caps.vector_links(empty).collect() == []
    only_bad = spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_caps.vector_links(only_bad).collect()] == [(3, 0, 3)]


def shingles_by_hand(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def join_by_hand(rows):
    sets = [shingles_by_hand(t) for _, t in rows]
    links = []
    holders = defaultdict(list)
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            for s in sets[n]:
                holders[s].append(n)
    common = Counter((a, b) for group in holders.values() for i, a in enumerate(group) for b in group[i + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    found = components(range(len(rows)), links)
    smallest = {}
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[found[n]] = min(doc, smallest.get(found[n], doc))
    return sorted(str((doc, len(sets[n]), None if doc is None else smallest[found[n]] if sets[n] else doc)) for n, (doc, _) in enumerate(rows))


def edited(words, share):
    return [w if random.random() > share else random.choice(["new", "other", "word"]) for w in words]


def documents():
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(60):
        base = random.choices(vocabulary, k=random.choice([3, 5, 6, 7, 8, 10, 14, 20, 45, 120, 400, 900]))
        for _ in range(random.choice([1, 2, 3, 9])):
            rows.append(" ".join(edited(base, random.choice([0, 0.005, 0.01, 0.02, 0.05]))))
    passage = random.choices(vocabulary, k=80)
    rows += [" ".join(random.choices(vocabulary, k=100) + passage) for _ in range(40)]
    # A chain: neighbours link, its ends do not.
    base = random.choices(vocabulary, k=200)
    for step in range(25):
        base = base[:step * 6] + [f"c{step}"] + base[step * 6 + 1 :]
        rows.append(" ".join(base))
    random.shuffle(rows)
    return list(enumerate(rows, 50))


def test_join_equals_brute_force(make_docs, awkward):
    rows = documents() + awkward + [(8, "One\tTWO three"), (9, "one two three four five six seven eight"), (10, "one two three four five six seven eight nine")]
    got = ngram_join.linked_documents(make_docs(rows))
    assert sorted(str((r.id, r.n_shingles, r.component_id)) for r in got.collect()) == join_by_hand(rows)


def test_join_with_large_groups_in_slices(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    monkeypatch.setattr(ngram_join, "SLICE", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 0)
    rows = documents()
    got = ngram_join.linked_documents(make_docs(rows))
    assert sorted(str((r.id, r.n_shingles, r.component_id)) for r in got.collect()) == join_by_hand(rows)


def test_one_of_each_group(make_docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text + " end"), (1, text + " end"), (2, "alone"), (4, None), (5, ""), (None, text), (None, text)]
    kept = ngram_join.one_of_each_group(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(
        str(x) for x in [(1, text + " end"), (2, "alone"), (4, None), (5, ""), (None, text), (None, text)]
    )
    assert ngram_join.linked_documents(make_docs([])).collect() == []


def test_entries_that_skip_the_meeting_are_dealt_over_all_buckets(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 100)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[: n % 40] + [f"n{n}"] + base[n % 40 :]) for n in range(60 * 128)]
    batches = [pa.record_batch({"text": texts})]
    extra = [(b, n) for block in ngram_join._blocks(16)(iter(batches)) for b, n in zip(block["bucket"].to_pylist(), block["entries"].to_pylist()) if b < 0]
    sizes = Counter()
    for bucket, entries in extra:
        sizes[bucket] += entries
    assert len(extra) >= 60 and min(sizes) >= -16 and len(sizes) > 8 and max(sizes.values()) <= 0.3 * sum(sizes.values())


def test_rows_in_no_group_stay_where_they_are(make_docs):
    rows = [(None, "a text")] * 150 + [(7, "")] * 150 + [(8, " \t\n\x0b\x0c\r")] * 50 + [(9, None)] * 50 + [(1, "a text"), (2, "A text"), (3, "\xa0 \x1f")]
    kept = ngram_join.one_of_each_group(make_docs(rows)).withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(r for r in rows if r[0] != 2)
    assert max(Counter(r.part for r in kept).values()) < 200


def test_signatures_meet_for_every_linked_pair():
    random.seed(4)
    bands = ngram_join.Bands()
    for size in (5, 8, 9, 13, 18, 30, 77, 300, 1500):
        for _ in range(30):
            pool = np.unique(np.random.default_rng(random.randrange(1 << 30)).integers(0, 1 << 63, size=3 * size, dtype=np.uint64))
            h = random.randint(1, max(1, 2 * size // 9))
            gone = random.randint(0, h)
            a, b = np.sort(pool[:size]), np.sort(pool[gone : size + h - gone])
            common = len(np.intersect1d(a, b))
            if 5 * common < 4 * (len(a) + len(b) - common):
                continue
            row = np.repeat([0, 1], [len(a), len(b)])
            at, values = ngram_join.signatures(row, np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
            assert set(values[at == 0].tolist()) & set(values[at == 1].tolist()) or len(a) == common == len(b)


def removed_by_hand(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc, _), text in zip(rows, texts):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append(str((doc, len(text), spans, bytes(b for b, g in zip(text, gone) if not g))))
    return sorted(out)


def test_repeats_equal_brute_force(make_docs, awkward, monkeypatch):
    random.seed(6)
    letters = "abcdefgh é\n"
    make = lambda n: "".join(random.choices(letters, k=n))
    shared = [make(random.choice([398, 399, 400, 401, 600, 1500])) for _ in range(8)]
    rows = [(20 + i, make(random.randint(0, 300)) + random.choice(shared) + make(random.randint(0, 300))) for i in range(40)]
    rows += [(70, make(450) * 2), (71, "z" * 401), (72, "yx" * 900), (73, make(5000)), (74, make(399)), (75, make(400))]
    rows += [(76, shared[4]), (77, shared[4][:-1])] + [r for r in awkward if len(r[1] or "") < 100_000]
    monkeypatch.setattr(suffix_dedup, "STRETCH_BYTES", 1000)  # long texts in several pieces
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 5000)
    got = suffix_dedup.remove_repeats(make_docs(rows))
    assert sorted(str((r.id, r.n_bytes, len(r.span_starts), bytes(r.kept))) for r in got.collect()) == removed_by_hand(rows)


def test_repeats_of_no_documents_and_long_texts(make_docs, awkward):
    assert suffix_dedup.remove_repeats(make_docs([])).collect() == []
    long_text = awkward[8][1]
    got = suffix_dedup.remove_repeats(make_docs([(1, long_text), (2, long_text)])).collect()
    assert [bytes(r.kept) for r in got] == [b"", b""]


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_structured_texts_have_fingerprints_of_their_own(n):
    """Sequences by the Thue-Morse rule collide under every polynomial hash modulo a power of two."""
    letters = ["".join(thue_morse(n, a, b)) for a, b in ("ab", "ba", "cd", "dc")]
    prints = [Fingerprints(np.frombuffer(t.encode(), dtype=np.uint8), which) for which in (0, 1) for t in letters]
    assert len({int(f.of(np.array([0]), np.array([n]))[0]) for f in prints}) == 8


def test_structured_texts_are_not_confused(make_docs):
    letters = ["".join(thue_morse(2048, a, b)) for a, b in ("ab", "ba", "cd", "dc")]
    rows = list(enumerate([*letters, "one two three", "one two three"]))
    linked = {r.id: r.component_id for r in ngram_join.linked_documents(make_docs(rows)).collect()}
    assert [linked[i] for i in range(6)] == [0, 1, 2, 3, 4, 4]
    assert {r.doc_id for r in ngram_join.one_of_each_group(make_docs(rows)).collect()} == {0, 1, 2, 3, 4}
    got = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    assert sorted(str((r.id, r.n_bytes, len(r.span_starts), bytes(r.kept))) for r in got) == removed_by_hand(rows)


def test_fingerprints_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 150_000).astype(np.uint8)
    data[100_000:100_300] = data[40:340]
    for which in (0, 1):
        base, prints = common._BASES[which] % common.PRIME, Fingerprints(data, which)
        for a, b in [(0, 0), (0, 1), (40, 340), (65_530, 65_600), (131_000, 131_200)]:
            value = sum((int(data[j]) + 1) * pow(base, j - a, common.PRIME) for j in range(a, b)) % common.PRIME
            assert prints.of(np.array([a]), np.array([b]))[0] == mixed(np.array([value], dtype=np.uint64))[0]
        grams = prints.grams(300)
        assert len(grams) == 149_701 and grams[40] == grams[100_000] and len(np.unique(grams)) == 149_700

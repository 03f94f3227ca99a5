"""Directly addressable codes: round trips, random access, and whole corpora against the library."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpuslens.llm import token_codes, token_files
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")


def file_of(documents, segment):
    stream = io.BytesIO()
    writer = token_codes.FileWriter(stream, segment)
    for doc, ids in documents:
        writer.add(doc, np.array(ids, dtype=np.uint32))
    writer.finish()
    data = stream.getvalue()
    return token_codes.TokenFile(lambda offset, size: data[offset : offset + size], len(data))


ids = st.one_of(st.integers(0, 255), st.integers(0, 49_407), st.integers(0, 2**32 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(ids, max_size=40)), max_size=12), st.integers(1, 60), st.data())
def test_files_hold_what_was_written(documents, segment, data):
    opened = file_of(documents, segment)
    whole = [i for _, some in documents for i in some]
    assert opened.docs == [doc for doc, _ in documents] and opened.n_tokens == len(whole)
    assert [opened.token(i) for i in range(len(whole))] == whole
    begin = data.draw(st.integers(0, len(whole)))
    end = data.draw(st.integers(begin, len(whole)))
    assert opened.tokens(begin, end).tolist() == whole[begin:end]
    back = []
    for docs, spans, some in opened.documents(at_once=30):
        back += [(doc, some[a - spans[0][0] : b - spans[0][0]].tolist()) for doc, (a, b) in zip(docs, spans)]
    assert back == [(doc, list(some)) for doc, some in documents]


def test_ranks_far_into_a_segment():
    random.seed(1)
    whole = [random.choice([random.randint(0, 60), random.randint(0, 50_000), 2**31]) for _ in range(150_000)]
    opened = file_of([(1, whole)], 1 << 20)
    for place in [0, 511, 512, 513, 1023, 1024, 65_535, 65_536, 149_999, *random.sample(range(150_000), 300)]:
        assert opened.token(place) == whole[place]
    assert opened.tokens(70_001, 140_003).tolist() == whole[70_001:140_003]
    for place in (-1, 150_000):
        with pytest.raises(IndexError):
            opened.token(place)


def test_an_id_is_read_from_a_few_bytes():
    rng = np.random.default_rng(3)
    stream = io.BytesIO()
    writer = token_codes.FileWriter(stream)
    writer.add(7, rng.geometric(0.001, 400_000).astype(np.uint32))
    writer.finish()
    data, read = stream.getvalue(), []
    opened = token_codes.TokenFile(lambda offset, size: read.append(size) or data[offset : offset + size], len(data))
    read.clear()
    opened.token(333_333)
    assert sum(read) < 400


def test_widths_are_the_best_split():
    rng = np.random.default_rng(5)
    some = rng.geometric(0.01, 3000).astype(np.uint32) - 1

    def cost(widths):
        total, rest = 0.0, some
        for number, width in enumerate(widths):
            total += len(rest) * (width + (1 + 32 / token_codes.RANK_PLACES if number + 1 < len(widths) else 0))
            rest = rest >> width
            rest = rest[rest > 0]
        return total

    def splits(bits):
        return [[bits]] + [[first, *rest] for first in range(1, bits) for rest in splits(bits - first)]

    most = int(token_codes.bit_lengths(some).max())
    assert cost(token_codes.level_widths(some)) == pytest.approx(min(map(cost, splits(most))))
    assert token_codes.level_widths(np.array([], dtype=np.uint32)) == [1]
    assert token_codes.bit_lengths(np.array([0, 1, 2, 3, 4, 255, 256, 2**31, 2**32 - 1])).tolist() == [1, 1, 2, 2, 3, 8, 9, 32, 32]


def order(row):
    return (row[0] is not None, row[0] or 0)


def test_corpora_equal_the_library(spark, make_docs, awkward, tmp_path):
    random.seed(6)
    pool = " \t\n'aAé'stredmvl12#.ΣσİÅéſŸ½²ß漢🙂<|endoftext|>"
    rows = awkward + [(1000 + i, "".join(random.choices(pool, k=random.randint(0, 40)))) for i in range(400)]
    random.shuffle(rows)
    path = str(tmp_path / "corpus")
    got = token_files.round_trip(make_docs(rows), WORD, path).collect()
    library = Tokenizer.from_file(WORD)
    want = {}
    for doc, text in rows:
        found = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        want.setdefault(doc, []).append(found)
    got.sort(key=lambda r: r.start)
    assert [order(r) for r in got] == sorted(order(r) for r in got)
    at = 0
    for row in got:
        assert row.start == at and row.n_tokens * 4 == len(row.ids)
        at += row.n_tokens
    for doc in want:
        assert sorted(bytes(r.ids) for r in got if r.doc_id == doc) == sorted(want[doc])

    corpus = token_files.TokenCorpus(path)
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in got), dtype="<u4").tolist()
    assert len(corpus) == len(whole) == at
    for place in random.sample(range(at), 200):
        assert corpus.token(place) == whole[place]
    assert corpus.tokens(at // 3, at - 5).tolist() == whole[at // 3 : at - 5]


def test_checksums_on_the_way_back(make_docs, tmp_path):
    row = token_files.round_trip(make_docs([(1, "one two")]), WORD, str(tmp_path / "c")).select("*", F.crc32("ids").alias("crc")).first()
    assert row.crc == zlib.crc32(bytes(row.ids)) and row.n_tokens == 3


def test_a_failed_write_leaves_no_corpus(spark, make_docs, tmp_path):
    path = str(tmp_path / "broken")
    spark.dataSource.register(token_files.TokenCodes)
    rows = spark.createDataFrame([(2, b"\x01\x00\x00\x00"), (1, b"\x02\x00\x00\x00")], "id long, ids binary").coalesce(1)
    with pytest.raises(Exception, match="(?s)buffer size|element size|Writing|fail"):
        rows.withColumn("ids", F.lit(b"abc")).write.format("token_codes").mode("append").save(path)
    with pytest.raises(Exception):
        token_files.read_tokens(spark, path).collect()
    # A later write below the same folder is a whole corpus; the files of the broken one are not in it.
    assert token_files.round_trip(make_docs([(5, "x")]), WORD, path).count() == 1


def test_files_out_of_order_are_refused(spark, tmp_path):
    spark.dataSource.register(token_files.TokenCodes)
    one = b"\x01\x00\x00\x00"
    falling = spark.createDataFrame([(2, one), (1, one)], "id long, ids binary").coalesce(1)
    rising = spark.createDataFrame([(1, one), (2, one)], "id long, ids binary").coalesce(1)
    for rows in (falling, rising.union(rising)):
        with pytest.raises(Exception, match="order"):
            rows.write.format("token_codes").mode("append").save(str(tmp_path / "mixed"))
    rising.write.format("token_codes").mode("append").save(str(tmp_path / "mixed"))
    assert sorted((r.doc_id, r.start) for r in token_files.read_tokens(spark, str(tmp_path / "mixed")).collect()) == [(1, 0), (2, 1)]


def test_a_corpus_is_replaced_on_demand_only(make_docs, spark, tmp_path):
    path = str(tmp_path / "c")
    token_files.write_tokens(make_docs([(1, "one")]), WORD, path)
    with pytest.raises(Exception, match="a corpus already"):
        token_files.write_tokens(make_docs([(2, "two")]), WORD, path)
    assert [r.doc_id for r in token_files.read_tokens(spark, path).collect()] == [1]
    token_files.encoded(make_docs([(3, "three")]), WORD).write.format("token_codes").mode("overwrite").save(path)
    assert [r.doc_id for r in token_files.read_tokens(spark, path).collect()] == [3]


def test_no_documents(make_docs, tmp_path):
    got = token_files.round_trip(make_docs([]), WORD, str(tmp_path / "none"))
    assert got.collect() == [] and got.columns == ["doc_id", "start", "n_tokens", "ids"]
    assert len(token_files.TokenCorpus(str(tmp_path / "none"))) == 0


def test_a_word_of_one_piece_is_kept_once():
    import public_tokenizers

    from corpuslens.llm import token_files
    from corpuslens.llm.pretokens import read_file

    coder = token_files.Encoder(read_file(public_tokenizers.path("word_bpe_49k.json")), token_files.WORD_PATTERN)
    first = coder.encode("alpha beta, alpha")
    assert coder.encode("alpha beta, alpha") == first and "alpha" in coder._words.young and "alpha" not in coder._pieces.young and "beta" in coder._pieces.young

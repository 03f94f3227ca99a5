"""Token counts and the codec against the library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import bpe_codec, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(awkward):
    random.seed(11)
    pool = " \t\n\r\x0b\x0c\x1c\x85\xa0aAé'stredmvl12#.ΣσİÅéſŸƓ½²ß漢🙂́<|endoftext|>"
    fuzz = ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(1500)]
    fuzz += ["a<|endoftext|>b <|startoftext|> ", "we're'LL it's", " " * 500, "ab" * 5000]
    return awkward + list(enumerate(fuzz, 1000))


def test_counts_equal_the_library(make_docs, texts):
    library = Tokenizer.from_file(WORD)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    got = token_counts.token_counts(make_docs(texts), WORD)
    assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in got.collect()) == want


def test_the_table_of_frequent_lengths_changes_no_count(make_docs, texts):
    some = make_docs(texts[:300])
    plain = token_counts.token_counts(some, WORD, frequent=0)
    assert sorted(map(str, plain.collect())) == sorted(map(str, token_counts.token_counts(some, WORD).collect()))


def test_frequent_lengths_are_those_of_the_library():
    content, library = bpe_codec.read_file(WORD), Tokenizer.from_file(WORD)
    found = token_counts.frequent_lengths(content, token_counts.WORD_PATTERN)
    assert len(found) > 30_000 and {"the", "of", "and"} <= set(found)
    some = random.Random(3).sample(sorted(found), 2000)
    assert [found[p] for p in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert len(token_counts.frequent_lengths(content, token_counts.WORD_PATTERN, 100)) == 100


def test_codec_equals_the_library(make_docs, texts):
    library = Tokenizer.from_file(BYTE)
    coded = bpe_codec.round_trip(make_docs(texts), BYTE).collect()
    got = sorted((str(r.id), r.ids, r.text) for r in coded)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert sorted(r.text for r in coded) == sorted(t or "" for _, t in texts)


def test_encode_and_decode_apart(make_docs, spark):
    encoded = bpe_codec.encode(make_docs([(1, "plain text"), (2, None)]), BYTE)
    back = {r.id: r.text for r in bpe_codec.decode(encoded, BYTE).collect()}
    assert back == {1: "plain text", 2: ""}
    odd = spark.createDataFrame([(1, None), (2, [50256, 99_999_999, 0]), (3, [])], "id long, ids array<int>")
    assert {r.id: r.text for r in bpe_codec.decode(odd, BYTE).collect()} == {1: "", 2: "<|endoftext|>!", 3: ""}


def test_cuts_fall_where_no_token_joins(make_docs):
    codec = bpe_codec.Codec(bpe_codec.read_file(BYTE), bpe_codec.BYTE_PATTERN)
    data = "naïve 漢字かな transformation".encode()
    fragments = codec.fragments(data)
    assert b"".join(fragments) == data and len(fragments) > 1
    for left, right in zip(fragments, fragments[1:]):
        pair = left[-1:] + right[:1]
        assert not any(pair in token for token in codec.token_bytes.values())


def test_no_documents(make_docs):
    assert token_counts.token_counts(make_docs([]), WORD).collect() == []
    assert bpe_codec.round_trip(make_docs([]), BYTE).collect() == []

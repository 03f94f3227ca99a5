"""Trained operators: exact search, held-out accuracy, awkward rows."""

import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import language_mixture, license_scan, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def examples():
    random.seed(2)
    plain = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(600):
        label = i % 3 == 0
        words = random.choices(plain, k=60) + (random.choices(["nastyterm", "rudeword", "vilething"], k=3) if label else [])
        random.shuffle(words)
        rows.append((i, int(label), " ".join(words)))
    return rows


def test_nearest_examples_are_exact(examples):
    index = toxicity.ExampleIndex([e[0] for e in examples], [e[1] for e in examples], [e[2] for e in examples], 300, neighbours=7, block=16)
    dense = np.zeros((index.blocks * index.block, len(index.vocabulary)))
    for b, lists in enumerate(index.lists):
        for term in np.flatnonzero(index.row_of[b] >= 0):
            dense[b * index.block : (b + 1) * index.block, term] = lists[index.row_of[b, term]]
    assert np.allclose(np.linalg.norm(dense[: len(index.ids)], axis=1), 1)
    for _, _, text in examples[:80]:
        terms, weights = index.vector_of_text(text)
        places, cosines = index.nearest(terms, weights)
        want = np.sort((dense[:, terms] @ weights))[::-1][: len(cosines)] if len(terms) else np.empty(0)
        assert np.allclose(cosines, want)


def test_scores_part_the_classes(examples, make_docs, awkward, spark):
    model = toxicity.ToxicityModel(examples[:400], 1 / 3)
    for _, label, text in examples[400:]:
        score, _, evidence, similarities = model.score(text)
        assert (score >= 0.5) == bool(label) and 0 <= score <= 1
        assert len(evidence) == len(similarities) and similarities == sorted(similarities, reverse=True)
    rows = toxicity.score_documents(make_docs(awkward), model).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score < 0.5 and r.evidence == [] for r in rows)
    assert toxicity.score_documents(make_docs([]), model).collect() == []
    kept = toxicity.without_toxic(make_docs([(1, "a nastyterm and a rudeword"), (2, None), (None, "fine")]), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_training_without_usable_labels(make_docs, spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    model = toxicity.train(make_docs([(1, "a"), (2, "b")]), labels)
    assert model.score("anything") == (0.0, -1.0, [], [])


def test_toxicity_on_held_out_rows(spark):
    from corpuslens.llm import load_queries

    rows = load_queries()[0]["op1_toxicity"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    clean = rows.join(labels, "doc_id").where("held_out AND toxic = 0")
    assert rows.count() == 1000 and clean.where("predicted = 0").count() == clean.count()
    toxic = rows.join(labels, "doc_id").where("held_out AND toxic = 1")
    assert toxic.where("predicted = 1").count() >= 0.6 * toxic.count()


def test_languages_of_held_out_rows(spark):
    from corpuslens.llm import load_queries

    rows = load_queries()[0]["op7_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    held = rows.join(docs, "doc_id").where("held_out")
    assert rows.count() == 1000 and held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_mixtures():
    model = language_mixture.LanguageModel(
        [("aa", "babo tabo rabo labo mabo " * 20), ("bb", "shrek threk chrek whrek phrek " * 20)]
    )
    both, one, none = model.mixtures(["babo tabo mabo rabo " * 5 + "shrek whrek phrek " * 5, "Labo RABO mabo tabo babo", " 12 ?! "])
    assert both[2] == ["aa", "bb"] and both[3] == pytest.approx([4 / 7, 3 / 7], abs=0.02) and both[0] == "aa"
    assert one[0] == "aa" and one[2] == ["aa"] and one[1] > 0.9
    assert none == ("und", 0.0, [], [])
    assert language_mixture.LanguageModel([]).mixtures(["some text"])[0][0] == "und"


def test_a_text_in_six_languages_has_six():
    random.seed(5)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "zäöüß"]
    words = [["".join(random.choices(x, k=5)) for _ in range(60)] for x in letters]
    names = [f"l{i}" for i in range(6)]
    model = language_mixture.LanguageModel([(n, " ".join(random.choices(w, k=400))) for n, w in zip(names, words)])
    texts = [" ".join(random.choice(words[i % k]) for i in range(240)) for k in range(1, 7)]
    got = model.mixtures([*texts, ""])
    assert [sorted(found) for _, _, found, _ in got[:6]] == [names[:k] for k in range(1, 7)] and got[6] == ("und", 0.0, [], [])
    for k, (_, score, _, shares) in enumerate(got[:6], 1):
        assert sum(shares) == pytest.approx(1) and score == pytest.approx(1 / k, abs=0.02)


def test_examples_are_the_lowest_hashes_of_a_language(make_docs, spark):
    rows = [(i, f"{'eins zwei drei' if i % 3 else 'one two three'} {i} wort{i}") for i in range(300)] + [(7, "twice"), (None, "no id"), (400, None)]
    docs = make_docs(rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("de"))
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).collect()
    chosen = set()
    for lang in ("en", "de"):
        own = sorted((r.h, r.doc_id) for r in known if r.lang == lang)[:40]
        chosen |= {i for _, i in own}
    want = language_mixture.LanguageModel(sorted((r.lang, r.text) for r in known if r.doc_id in chosen))
    got = language_mixture.train(docs, examples=40)
    assert got.languages == want.languages and np.allclose(got.table, want.table)


def test_languages_of_awkward_rows(make_docs, awkward):
    model = language_mixture.LanguageModel([("en", "one two three four words"), ("xx", "zzz yyy xxx")])
    rows = language_mixture.infer(make_docs(awkward), model).collect()
    assert len(rows) == len(awkward)
    assert all(r.language == "und" and r.score == 0 for r in rows if r.id in (2, 3))
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_mixture.infer(make_docs([]), model).collect() == []


@pytest.fixture(scope="module")
def licences():
    random.seed(3)
    return license_scan.LicenceModel([" ".join(random.choices(["river", "house", "green", "walk", "the", "of"], k=12)) for _ in range(300)])


def test_licence_families(licences, make_docs, awkward):
    text = "Some prose.\n\nReleased under the MIT License.\nThe licensed driver had permission to drive.\nLicensed under the Apache License, Version 2.0."
    count, families, confidences, places, _ = licences.scan(text)
    assert count == 4 and families == ["MIT", "Apache"] and places == [1, 3] and min(confidences) > 0.5
    for family, notices in license_scan.NOTICES.items():
        for notice in notices:
            assert licences.predict(license_scan.words_of(notice))[0] == family, notice
            assert licences.scan("We say: " + notice + " and no more.")[1] == [family]
    rows = license_scan.scan_documents(make_docs(awkward), licences).collect()
    assert len(rows) == len(awkward) and all(r.families == [] for r in rows)


def test_wrapped_licence_notices(licences):
    for family, notices in license_scan.NOTICES.items():
        for notice in notices:
            for width in (14, 24, 40, 60, 72):
                for mark in ("", " * ", "# ", "// "):
                    lines = [mark + line for line in textwrap.wrap(notice + ".", width)]
                    text = "\n".join(["Some prose of a house.", "", *lines, "", "The green river."])
                    count, families, _, places, unconfirmed = licences.scan(text)
                    assert (families, places, unconfirmed) == ([family], [1], 0), text
                    assert count == len(lines) + 2


def test_licence_notices_within_long_lines_and_beside_each_other(licences):
    random.seed(4)
    filler = " ".join(random.choices(["river", "house", "green", "walk"], k=300))
    assert licences.scan(f"{filler} Released under the MIT License {filler}")[1:4:2] == (["MIT"], [0])
    both = "Licensed under the Apache License, Version 2.0 or Released under the\nMIT License"
    assert licences.scan(both)[1:4:2] == (["Apache", "MIT"], [0, 0])


def test_licence_training_without_documents(make_docs):
    model = license_scan.train(make_docs([]))
    assert model.scan("Licensed under CC BY-NC 4.0.")[1] == ["CC-BY-NC"]


def test_licences_of_the_corpus(spark):
    from corpuslens.llm import load_queries

    rows = load_queries()[0]["op8_license_scan"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    joined = rows.join(docs, "doc_id").collect()
    named = {"MIT": "MIT License", "Apache": "Apache License", "GPL": "GNU General Public License", "CC-BY-NC": "CC BY-NC"}
    assert len(joined) == 1000
    for r in joined:
        assert r.families == sorted(f for f, mark in named.items() if mark in r.text)

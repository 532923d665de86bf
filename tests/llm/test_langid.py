import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import langid
from corpusloom.llm.textops import Scanner, text_slices
from tests.llm.helpers import doc, table

SF = "/root/testdata/sf0.01/documents.parquet"
EN = "the cat sat on the mat and the dog went to the house with them "
FR = "le chat est sur la table et les chiens sont dans une maison avec eux "


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([("en", EN * 20), ("fr", FR * 20)], "lang string, text string")
    return langid.Model.fit(docs)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_mixtures(model):
    texts = [EN, FR, EN * 3 + FR, "", "123 !!", EN + FR * 3]
    (_, _, data, offsets), = text_slices(pa.array(texts))
    shares = langid.mixtures(model, Scanner(), data, offsets)
    assert shares[0].tolist() == [1, 0] and shares[1].tolist() == [0, 1]
    assert shares[2][0] == pytest.approx(0.75, abs=0.08) and shares[2].sum() == pytest.approx(1)
    assert shares[5][1] == pytest.approx(0.75, abs=0.08)
    assert shares[3].tolist() == [0, 0]


def test_a_text_does_not_depend_on_its_neighbours(model):
    scanner = Scanner()
    texts = ["la maison", "mat and", "x", "", "dans les", EN + FR]
    (_, _, data, offsets), = text_slices(pa.array(texts))
    together = [langid.word_grams(scanner, data, offsets)]
    bucket, first, bounds = together[0]
    edge = np.concatenate([first, [len(bucket)]])[bounds]
    for i, text in enumerate(texts):
        (_, _, alone, at), = text_slices(pa.array([text]))
        assert (langid.word_grams(scanner, alone, at)[0] == bucket[edge[i] : edge[i + 1]]).all()


def test_odd_rows(spark):
    rows = [doc(i, EN * 5, "en") for i in range(12)] + [doc(i + 50, FR * 5, "fr") for i in range(12)]
    rows += [doc(None, EN, None), doc(900, None, "en"), doc(901, "", None), doc(902, "12 34 !", "fr"),
             doc(903, EN * 4000, None), doc(3, EN * 5, "en"), doc(904, "漢", None)]
    docs = table(spark, rows).selectExpr("*", "'x' AS lang_pred", "'y' AS _text", "1 AS score")
    got = langid.language_id(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].languages) == ("und", 0.0, [])
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out
    assert by_id[903].lang_pred == "en" and by_id[904].lang_pred in ("en", "fr")
    assert langid.language_id(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}


def test_rejected_documents_go_and_columns_stay(spark, model):
    rows = [doc(1, EN, "en"), doc(2, "99", "en"), doc(3, None), doc(4, FR, None), doc(4, FR, None)]
    docs = table(spark, rows).selectExpr("*", "'x' AS _pred", "1 AS score", "2 AS _k0")
    kept = langid.keep_identified(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, "en"), (4, "fr"), (4, "fr")]


def test_mixtures_of_few_languages_are_kept(spark):
    rng = random.Random(3)
    languages = {f"l{i}": [f"{chr(97 + i)}{rng.randrange(10**6)}" for _ in range(60)]
                 for i in range(4)}
    learned = [doc(i, " ".join(rng.choices(languages[f"l{i % 4}"], k=80)), lang=f"l{i % 4}")
               for i in range(80)]
    mixed = sum((rng.choices(languages[f"l{i}"], k=n) for i, n in ((0, 40), (1, 30), (2, 30))), [])
    asked = [doc(100, " ".join(mixed)), doc(101, None), doc(102, "12 34")]
    model = langid.Model.fit(table(spark, learned).select("lang", "text"))
    kept = langid.keep_identified(table(spark, asked), model, 0.5).collect()
    assert [r.doc_id for r in kept] == [100]

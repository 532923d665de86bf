import collections
import random

import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS, doc, groups, mutate, prose, shingles, table, words

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "mix_sources", "pack"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Results of every stage over odd rows, written and read again."""
    rng = random.Random(5)
    rows = [doc(i, "\n".join(" ".join(prose(rng, rng.randrange(5, 60), 3000))
                             for _ in range(rng.randrange(1, 5))),
                source=rng.choice(["a", "b", None])) for i in range(80)]
    base = prose(rng, 300, 3000)
    rows += [doc(200 + i, "\n".join(" ".join(mutate(rng, base, 6)[j : j + 6])
                                    for j in range(0, 300, 6))) for i in range(6)]
    rows += [rows[0], rows[0], doc(None, rows[1][1]), doc(None, "a text of nobody"),
             doc(None, "a text of nobody"), doc(300, None), doc(301, ""), doc(302, "12 34"),
             (None, None, None, None, None), doc(303, "lone words " * 9000, lang=None)]
    folder, out = tmp_path_factory.mktemp("pipeline"), []
    docs = table(spark, rows).selectExpr(
        "*", "1 AS size", "'x' AS shard", "2 AS n_lines", "3 AS score", "4 AS node")
    for i, (name, stage) in enumerate([("documents", None), *corpus_pipeline.STAGES]):
        made = docs if stage is None else stage(spark, docs, str(folder))
        made.write.parquet(str(folder / f"{i}-{name}"))
        docs = spark.read.parquet(str(folder / f"{i}-{name}"))
        out.append(docs)
    return out


def test_columns_stay(stored):
    assert all(d.columns == stored[0].columns for d in stored[:5])
    assert stored[0].columns[:5] == [c.split()[0] for c in DOCS.split(", ")]


def test_language_stage_drops_only_texts_without_one(stored):
    before, after = stored[0].collect(), stored[1].collect()
    want = collections.Counter((r.doc_id, r.text) for r in before
                               if r.text and any(c.isalpha() for c in r.text))
    assert collections.Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.lang == "en" for r in after)


def test_line_stage(stored):
    got = stored[2].collect()
    lines = collections.Counter(
        line for r in got for line in r.text.split("\n") if line.strip())
    assert max(lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.doc_id for r in got} >= set(range(80)) | {303}


def test_near_stage_keeps_one_of_each_group(stored):
    before, after = stored[2].collect(), stored[3].collect()
    sets = {i: shingles(r.text, 5) for i, r in enumerate(before)}
    components = groups(sets)
    assert len(after) == len(set(components.values()))
    left = groups({i: shingles(r.text, 5) for i, r in enumerate(after)})
    assert all(k == v for k, v in left.items())


def test_near_stage_on_repeated_rows(spark, tmp_path):
    rows = [doc(1, "a b c d e f g")] * 4 + [doc(None, "p q r s t u")] * 3 + [doc(0, "p q r s t u")]
    table(spark, rows).write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert sorted((r.doc_id, r.text[0]) for r in got.collect()) == [(0, "p"), (1, "a")]


def test_mix_stage(stored):
    before = {(r.doc_id, r.source): r.text for r in stored[3].collect()}
    taken = collections.Counter()
    for r in stored[4].collect():
        assert before[r.doc_id, r.source].startswith(r.text)
        taken[r.doc_id, r.source] += len(words(r.text))
    assert all(n <= 3 * len(words(before[k])) for k, n in taken.items())
    total = sum(len(words(t)) for t in before.values())
    assert abs(sum(taken.values()) - total) < 0.02 * total


def test_packed_tokens_are_those_of_the_mix(stored):
    want = collections.Counter()
    for r in stored[4].collect():
        want[r.doc_id] += len(words(r.text))
    got = collections.Counter()
    for r in stored[5].collect():
        got[r.doc_id] += r.n_tokens
        assert r.bin_offset + r.n_tokens <= r.bin_capacity
    assert got == want


def test_empty_documents(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, "")
        assert result.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "mix_sources"])
def test_a_stage_holds_when_the_splits_change_between_scans(spark, tmp_path, name, monkeypatch):
    rng = random.Random(9)
    rows = [doc(i, " ".join(prose(rng, 30, 3000))) for i in range(60)]
    rows += [doc(100 + i, rows[i][1]) for i in range(20)]
    table(spark, rows).coalesce(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = sorted(r.text for r in dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect())
    for module in (corpus_pipeline.lines, corpus_pipeline.near, corpus_pipeline.mixing):
        write = module.materialize

        def resplit(df, table_name, write=write):
            made = write(df, table_name)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            return made

        monkeypatch.setattr(module, "materialize", resplit)
    try:
        # as when an executor comes or goes after the first scan
        got = dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.text for r in got) == want


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "mix_sources"])
def test_columns_with_the_stages_own_names(spark, tmp_path, name):
    """Columns named like helpers are data like any other."""
    rng = random.Random(11)
    rows = [doc(i, " ".join(prose(rng, 30, 3000))) for i in range(40)]
    docs = table(spark, rows).selectExpr(
        "*", "7 AS _place", "'t' AS _key", "'r' AS _row", "1 AS _stored_row", "2 AS _PLACE_")
    docs.write.parquet(str(tmp_path / "d"))
    for given in (docs, spark.read.parquet(str(tmp_path / "d"))):
        got = dict(corpus_pipeline.STAGES)[name](spark, given, "")
        assert got.columns == docs.columns
        kept = got.collect()
        assert {(r["_place"], r["_key"], r["_row"], r["_stored_row"]) for r in kept} == {
            (7, "t", "r", 1)}
        assert 36 <= len(kept) <= 44

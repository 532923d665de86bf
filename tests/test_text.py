"""Text expressions against plain Python on awkward strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numbers, text as tx
from corpusloom.operators import textmetrics as tm

TEXTS = [
    "One two three. Four five six. Seven eight nine.",
    "no terminator at all",
    "  no terminator and edges  ",
    "Closed. trailing fragment",
    "...Leading dots. Then text?! And more... (aside) done",
    " ... spaced dots. . x.",
    "But this. and that! So what? yet again. Butter is no opener.",
    "It's here, they're not; don't. l'été d'accord rock'n'roll",
    "été's wall. naïve coöperation nbsp em-space.",
    "A — dash. (paren) (unclosed",
    "()",
    "", " \n\t ", " 　", ".", "!?", "a.", "\x1c sep\x1farated \x85 words.",
    "Line one.\nLine two\nstill two. \nThree!",
    "repeat repeat repeat Repeat 123 4x4 ünïcode ÄÖ",
    "x" * 200 + ". " + "y " * 40 + ".",
]


def random_texts(n=150, seed=11):
    rng = random.Random(seed)
    parts = ["but", "And", "so", "word", "don't", "(a b)", "—", ".", "!", "?", "...", " ", "  ", "\n",
             " ", "é", "A1", "yet,", "it's."]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40)))
            for _ in range(n)]


#: text, then by hand: words, sentences, mean and spread of sentence lengths, spread over
#: mean, distinct over all lower-case terms, markers, dash, parenthesis, openers, contraction
MEASURED = [
    ("One two three. Four five six. Seven eight nine.",
     (9, 3, 3.0, 0.0, 0.0, 1.0, 0, False, False, 0, False)),
    ("no terminator at all", (4, 1, 4.0, 0.0, 0.0, 1.0, 0, False, False, 0, False)),
    ("Closed. trailing fragment", (3, 1, 1.0, 0.0, 0.0, 1.0, 0, False, False, 0, False)),
    ("One. Two three four.", (4, 2, 2.0, 1.0, 0.5, 1.0, 0, False, False, 0, False)),
    ("a b c d e f. g.", (7, 2, 3.5, 2.5, 0.71, 1.0, 0, False, False, 0, False)),
    ("the the the the. The cat", (6, 1, 4.0, 0.0, 0.0, 0.33, 0, False, False, 0, False)),
    ("But this. and that! So what? yet again. Butter is no opener.",
     (12, 5, 2.4, 0.8, 0.33, 1.0, 1, False, False, 4, False)),
    ("A — dash. (paren) (unclosed", (5, 1, 3.0, 0.0, 0.0, 1.0, 2, True, True, 0, False)),
    ("It's here, they're not.", (4, 1, 4.0, 0.0, 0.0, 1.0, 1, False, False, 0, True)),
    ("rock'n'roll l'été", (2, 1, 2.0, 0.0, 0.0, 1.0, 0, False, False, 0, False)),
    ("()", (1, 1, 1.0, 0.0, 0.0, 0.0, 0, False, False, 0, False)),
    ("", (None,) * 11),
    (" \n\t ", (None,) * 11),
]


def test_metrics_of_measured_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MEASURED)], "id int, text string")
    for r in tm.text_metrics(df).collect():
        text, want = MEASURED[r["id"]]
        assert tuple(r[c] for c in tm.METRIC_COLUMNS) == want, repr(text)


def test_metric_properties(spark):
    """Blanks behind a text change nothing; counts and shares keep their bounds."""
    texts = TEXTS + random_texts()
    shown = [(2 * i, t) for i, t in enumerate(texts)]
    shown += [(2 * i + 1, f"{t}\t \n") for i, t in enumerate(texts)]
    got = {r["id"]: r for r in tm.text_metrics(
        spark.createDataFrame(shown, "id int, text string")).collect()}
    for i, text in enumerate(texts):
        row, padded = got[2 * i], got[2 * i + 1]
        assert [row[c] for c in tm.METRIC_COLUMNS] == [padded[c] for c in tm.METRIC_COLUMNS], repr(text)
        if not text.strip():
            assert row["word_count"] is None
            continue
        assert row["word_count"] == len(text.split())
        assert 0 <= row["ttr"] <= 1 and row["burstiness"] >= 0
        assert row["human_markers"] <= 4 and row["sentence_count"] >= 1


def test_sentences_and_words_match_python(spark):
    texts = TEXTS + random_texts(seed=12)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", tx.sentences(F.col("text")).alias("s"), tx.words(F.col("text")).alias("w"),
                     tx.word_count(F.col("text")).alias("n"), tx.strip(F.col("text")).alias("t")).collect()
    for r in rows:
        text = texts[r["id"]]
        found = re.findall(r"[^.!?]+[.!?]+", text)
        assert r["s"] == ([s.strip() for s in found] if found else [text]), repr(text)
        assert r["w"] == text.split(), repr(text)
        assert r["n"] == len(text.split()), repr(text)
        assert r["t"] == text.strip(), repr(text)


def test_long_text_without_terminator_is_linear(spark):
    text = "word " * 400_000
    df = spark.createDataFrame([(text,)], "text string")
    row = tm.text_metrics(df).select("sentence_count", "word_count").first()
    assert tuple(row) == (1, 400_000)


def test_rounding_matches_python(spark):
    rng = random.Random(1)
    values = [2.675, 2.65, 0.125, 0.375, 2.5, 3.5, 0.45, 12.25, 12.35, 1.005, 0.0, 1e-9]
    values += [rng.randint(0, 4000) / rng.randint(1, 400) for _ in range(3000)]
    values += [rng.randint(0, 100000) / 1000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in df.select(numbers.round_exact(F.col("x"), digits)).collect()]
        assert got == [float(round(v, digits)) for v in values], digits


def test_rounding_sql_matches_python():
    import duckdb

    con = duckdb.connect()
    for v in (2.675, 2.65, 0.125, 0.375, 12.35, 1.005):
        sql = f"SELECT {numbers.round_exact_sql(f'{v}::DOUBLE', 2)}"
        assert con.execute(sql).fetchone()[0] == round(v, 2)


#: burstiness, mean length, type-token ratio, markers -> score by hand
SCORED = [
    ((0.2, 20.0, 0.4, 0), 97), ((0.2, 20.0, 0.4, 1), 89), ((0.3, 19.0, 0.45, 0), 74),
    ((0.49, 26.0, 0.6, 2), 58), ((0.5, 15.0, 0.5, 0), 42), ((0.6, 12.0, 0.61, 0), 34),
    ((0.61, 30.0, 0.7, 0), 24), ((0.8, 31.0, 0.71, 0), 7), ((0.81, 11.9, 0.9, 4), 0),
    ((0.0, 22.0, 0.0, 0), 97),
]


def test_heuristic_score(spark):
    df = spark.createDataFrame(
        [(*m, want, 10) for m, want in SCORED],
        "burstiness double, avg_sent_len double, ttr double, human_markers int, want int,"
        " word_count int")
    for r in df.withColumn("score", tm.heuristic_score()).collect():
        assert r["score"] == r["want"], r
    nothing = df.limit(1).withColumn("word_count", F.lit(None).cast("int"))
    assert nothing.select(tm.heuristic_score().alias("s")).first()["s"] == 0


def test_blended_scores(spark):
    rows = [("One two three. Four five six. Seven eight nine.", 80.0),
            ("One two three. Four five six. Seven eight nine.", None), ("", 90.0),
            ("word " * 50 + ".", 10.0)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)],
                               "id int, text string, p double")
    got = {r["id"]: r for r in tm.score_texts(df, detector_col="p").withColumn(
        "e", tm.explanation()).collect()}
    # 50 + 25 - 10 - 15 = 50; 50 * 0.6 + 80 * 0.4 = 62
    assert (got[0]["heuristic_score"], got[0]["ai_percentage"]) == (50, 62)
    assert got[1]["ai_percentage"] == 50 and got[0]["confidence"] == 0.6
    assert (got[2]["heuristic_score"], got[2]["ai_percentage"]) == (0, 36)
    assert got[2]["e"] == "Unable to analyze text." != got[0]["e"]
    # 50 + 25 - 10 + 10 = 75; 75 * 0.6 + 10 * 0.4 = 49
    assert (got[3]["heuristic_score"], got[3]["ai_percentage"], got[3]["confidence"]) == (75, 49, 0.85)


@pytest.mark.parametrize("scores, want", [
    ([80, 60, 20, 5], (2, 20, 80, 2, True)),     # stops when 20 is reached exactly
    ([80, 60, 50, 40], (3, 40, 80, 3, False)),   # never reached
    ([30, 70, 60, 50], (0, 30, 30, 3, False)),   # the original stays best
    ([10, 40, 30, 25], (0, 10, 10, 3, True)),    # a good original does not stop the run
    ([90, 40, 40, 60], (1, 40, 90, 3, False)),   # ties go to the earlier pass
])
def test_best_of_passes(spark, scores, want):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)],
                               "text_id int, pass int, score double")
    r = tm.best_of_passes(df).first()
    assert (r["best_pass"], r["best_score"], r["original_score"], r["passes_used"],
            r["target_reached"]) == want


def test_parse_rewrite_response(spark):
    raws = ['```json\n{"humanized": "new {x}", "changes": ["a", "b"]}\n```', '{"changes": []}',
            "plain text", "{bad json}", 'pre {"humanized": "n"} post']
    df = spark.createDataFrame([(i, "orig", r) for i, r in enumerate(raws)],
                               "id int, original string, raw string")
    got = [(r["humanized"], r["changes"]) for r in tm.parse_rewrite_response(df).orderBy("id").collect()]
    stock = ["Rewrite generated"]
    assert got == [("new {x}", ["a", "b"]), ("orig", []), ("plain text", stock),
                   ("{bad json}", stock), ("n", [])]


def test_versions_are_never_broadcast(spark):
    versions = spark.range(5).selectExpr(
        "id AS text_id", "explode(array(0, 1)) AS pass", "50.0D - id AS score",
        "0.5D AS burstiness", "0.5D AS ttr", "1 AS human_markers", "array('a') AS changes")
    summary = tm.change_summary(tm.best_of_passes(versions), versions)
    assert summary.count() == 5
    for df in (summary, tm.pass_report(versions)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

"""Queries over the documents' texts: words, sentences, style metrics, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import textmetrics as tm
from corpusloom.plans import sqltext as sx
from corpusloom.plans.registry import cte, query
from corpusloom.functions.numbers import round_exact_sql
from corpusloom.sources import readers, views


def plain(spark, d):
    return readers.spread(readers.read_table(spark, d, "documents")).select("doc_id", "text")


def texts(spark, d):
    """Documents with a detector probability column that is sometimes missing."""
    return readers.spread(readers.read_table(spark, d, "documents")).select(
        "doc_id", "text",
        F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") % 101).cast("double").alias("detector"),
    )


@query("tokenize_words", f"""
SELECT doc_id, len(w) AS n_words, array_to_string(w, '|') AS words
FROM (SELECT doc_id, {sx.words('text')} AS w FROM documents)
""")
def tokenize_words(spark, d):
    return (
        plain(spark, d)
        .select("doc_id", tx.words(F.col("text")).alias("w"))
        .select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "|").alias("words"))
    )


_found = f"regexp_extract_all(text, '{tx.SENTENCE}')"
_sents = (f"CASE WHEN len({_found}) = 0 THEN [text] "
          f"ELSE list_transform({_found}, lambda s: {sx.strip('s')}) END")


@query("split_sentences", f"""
SELECT doc_id, generate_subscripts(s, 1) - 1 AS sentence_no, unnest(s) AS sentence
FROM (SELECT doc_id, {_sents} AS s FROM documents)
""")
def split_sentences(spark, d):
    return plain(spark, d).select(
        "doc_id", F.posexplode_outer(tx.sentences(F.col("text"))).alias("sentence_no", "sentence")
    ).withColumn("sentence_no", F.col("sentence_no").cast("long"))


cte("tm0", f"""
SELECT *, list_sum(lens) / len(lens) AS mean FROM (
  SELECT *, list_transform(sents, lambda s: len({sx.words('s')})::DOUBLE) AS lens,
    {sx.letters_only('text')} AS terms, len({sx.words('text')}) AS word_count
  FROM (SELECT doc_id, n_chars, text, {_sents} AS sents FROM documents WHERE {sx.has_text('text')}))
""")
cte("tm1", """
SELECT *, sqrt(list_sum(list_transform(lens, lambda x: (x - mean) * (x - mean))) / len(lens)) AS std,
  len(list_distinct(terms))::DOUBLE / greatest(len(terms), 1) AS ttr_raw
FROM tm0
""", ("tm0",))
cte("tm", f"""
SELECT *, has_em_dash::INT + has_parenthetical::INT + (starts_with_but_and > 0)::INT
    + has_contractions::INT AS human_markers FROM (
SELECT doc_id, n_chars, word_count, len(sents) AS sentence_count,
  {round_exact_sql('mean', 1)} AS avg_sent_len, {round_exact_sql('std', 1)} AS std_dev,
  {round_exact_sql('std / CASE WHEN mean = 0 THEN 1 ELSE mean END', 2)} AS burstiness,
  {round_exact_sql('ttr_raw', 2)} AS ttr,
  contains(text, '{tm.EM_DASH}') AS has_em_dash,
  regexp_matches(text, '{tm.PARENTHETICAL}') AS has_parenthetical,
  len(list_filter(sents, lambda s: regexp_matches(s, '{tm.OPENING_WORD}'))) AS starts_with_but_and,
  regexp_matches(text, '{tm.CONTRACTION.replace("'", "''")}') AS has_contractions
FROM tm1)
""", ("tm1",))
_score = """
SELECT *, CASE WHEN word_count IS NULL THEN 0 ELSE greatest(0, least(100, 50
    + CASE WHEN burstiness < 0.3 THEN 25 WHEN burstiness < 0.5 THEN 12
           WHEN burstiness > 0.8 THEN -25 WHEN burstiness > 0.6 THEN -18 ELSE -8 END
    + CASE WHEN avg_sent_len BETWEEN 19 AND 26 THEN 12
           WHEN avg_sent_len < 12 OR avg_sent_len > 30 THEN -10 ELSE 0 END
    + CASE WHEN ttr < 0.45 THEN 10 WHEN ttr > 0.7 THEN -15 WHEN ttr > 0.6 THEN -8 ELSE 0 END
    - human_markers * 8)) END AS heuristic_score
FROM (SELECT d.doc_id, d.n_chars AS chars, tm.* EXCLUDE (doc_id, n_chars)
      FROM documents d LEFT JOIN tm USING (doc_id))
"""
cte("scored", f"""
SELECT *, {round_exact_sql("heuristic_score * 0.6::DOUBLE + detector_score * 0.4::DOUBLE", 0)} AS ai_percentage,
  CASE WHEN word_count >= 50 THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence
FROM (SELECT *, CASE WHEN doc_id % 3 > 0 THEN (chars % 101)::DOUBLE ELSE 50.0 END AS detector_score
      FROM ({_score}))
""", ("tm",))


@query("text_metrics", f"""
SELECT d.doc_id, {', '.join('tm.' + c for c in tm.METRIC_COLUMNS)}
FROM documents d LEFT JOIN tm USING (doc_id)
""", ("tm",))
def text_metrics(spark, d):
    return tm.text_metrics(plain(spark, d)).drop("text")


@query("heuristic_score", "SELECT doc_id, heuristic_score FROM scored", ("scored",))
def heuristic_score(spark, d):
    return tm.text_metrics(
        plain(spark, d)
    ).select("doc_id", tm.heuristic_score().alias("heuristic_score"))


@query("blend_score", """
SELECT doc_id, heuristic_score, detector_score, ai_percentage, confidence FROM scored
""", ("scored",))
def blend_score(spark, d):
    return tm.score_texts(texts(spark, d), detector_col="detector").select(
        "doc_id", "heuristic_score", "detector_score", "ai_percentage", "confidence"
    )


@query("verdict", """
SELECT doc_id, CASE WHEN ai_percentage > 70 THEN 'ai' WHEN ai_percentage > 40 THEN 'mixed'
    ELSE 'human' END AS verdict,
  CASE WHEN ai_percentage > 60 THEN 'ai' WHEN ai_percentage > 30 THEN 'mixed'
    ELSE 'human' END AS verdict_60_30
FROM scored
""", ("scored",))
def verdict(spark, d):
    return tm.score_texts(texts(spark, d), detector_col="detector").select(
        "doc_id",
        tm.verdict(F.col("ai_percentage")).alias("verdict"),
        tm.verdict(F.col("ai_percentage"), 60, 30).alias("verdict_60_30"),
    )


@query("explanation", """
SELECT doc_id, CASE WHEN word_count IS NULL THEN 'Unable to analyze text.' ELSE
  concat_ws(chr(10),
    CASE WHEN ai_percentage > 70 THEN '**Verdict:** Likely AI-generated (' || ai_percentage::INT || '% probability).'
         WHEN ai_percentage > 40 THEN '**Verdict:** Mixed signals (' || ai_percentage::INT || '% AI probability).'
         ELSE '**Verdict:** Likely human-written (' || (100 - ai_percentage::INT) || '% confidence).' END,
    chr(10) || '**Burstiness:** ' || burstiness::VARCHAR ||
      CASE WHEN burstiness >= 0.5 THEN ' (human-like variance ✓)'
           WHEN burstiness < 0.3 THEN ' (too uniform - AI marker ✗)' ELSE ' (moderate)' END,
    '**Lexical Diversity:** ' || ttr::VARCHAR ||
      CASE WHEN ttr >= 0.6 THEN ' (rich vocabulary ✓)'
           WHEN ttr < 0.45 THEN ' (repetitive - AI marker ✗)' ELSE ' (moderate)' END,
    '**Avg Sentence Length:** ' || avg_sent_len::VARCHAR ||
      CASE WHEN avg_sent_len BETWEEN 19 AND 26 THEN ' words (in AI sweet spot 19-26 ✗)'
           ELSE ' words (outside AI range ✓)' END,
    CASE WHEN human_markers > 0 THEN '**Human markers detected:** ' || concat_ws(', ',
        CASE WHEN has_em_dash THEN 'em-dashes' END, CASE WHEN has_parenthetical THEN 'parentheticals' END,
        CASE WHEN has_contractions THEN 'contractions' END,
        CASE WHEN starts_with_but_and > 0 THEN 'varied sentence starts' END) || ' ✓'
      ELSE '**Human markers:** None detected ✗' END,
    chr(10) || '**Component scores:** Heuristic=' || heuristic_score || '%, RoBERTa=' ||
      detector_score::INT || '%') END AS explanation
FROM scored
""", ("scored",))
def explanation(spark, d):
    return tm.score_texts(texts(spark, d), detector_col="detector").select(
        "doc_id", tm.explanation().alias("explanation")
    )


# ------------------------------------------------------------------- rewrite versions


@query("best_of_passes", "SELECT * FROM best", ("best",))
def best_of_passes(spark, d):
    return tm.best_of_passes(views.rewrite_versions(spark, d))


@query("change_summary", """
SELECT text_id, concat_ws(chr(10),
    CASE WHEN target_reached THEN '✅ **Target reached!** AI score: ' || original_score::INT || '% → **' ||
        best_score::INT || '%** in ' || passes_used || ' pass' || CASE WHEN passes_used > 1 THEN 'es' ELSE '' END
      ELSE '⚠ **Best result after ' || passes_used || ' passes:** ' || original_score::INT || '% → **' ||
        best_score::INT || '%** (target was <20%)' END,
    chr(10) || '**Metric Changes:**',
    CASE WHEN b1 > b0 THEN '✓ Burstiness: ' || b0::VARCHAR || ' → ' || b1::VARCHAR || ' (more sentence variety)' END,
    CASE WHEN t1 > t0 THEN '✓ Lexical diversity: ' || t0::VARCHAR || ' → ' || t1::VARCHAR || ' (richer vocabulary)' END,
    CASE WHEN h1 > h0 THEN '✓ Human markers: ' || h0 || ' → ' || h1 END,
    CASE WHEN len(changes) > 0 THEN chr(10) || '**Specific Changes Made:**' END,
    CASE WHEN len(changes) > 0 THEN
      array_to_string(list_transform(changes[1:6], lambda c: '• ' || c), chr(10)) END) AS summary
FROM (
  SELECT b.*, max(v.burstiness) FILTER (v.pass = 0) AS b0, max(v.burstiness) FILTER (v.pass = best_pass) AS b1,
    max(v.ttr) FILTER (v.pass = 0) AS t0, max(v.ttr) FILTER (v.pass = best_pass) AS t1,
    max(v.human_markers) FILTER (v.pass = 0) AS h0,
    max(v.human_markers) FILTER (v.pass = best_pass) AS h1, any_value(c.changes) AS changes
  FROM best b JOIN versions v ON v.text_id = b.text_id AND v.pass <= b.passes_used
  LEFT JOIN (
    SELECT text_id, list(change ORDER BY place) AS changes FROM (
      SELECT text_id, change, min(pass * 10 + i) AS place FROM (
        SELECT text_id, pass, unnest(changes) AS change, generate_subscripts(changes, 1) AS i
        FROM used_versions WHERE pass >= 1) GROUP BY text_id, change) GROUP BY text_id) c
    ON c.text_id = b.text_id
  GROUP BY b.text_id, b.best_pass, b.best_score, b.original_score, b.passes_used, b.target_reached)
""", ("best", "versions", "used_versions"))
def change_summary(spark, d):
    versions = views.rewrite_versions(spark, d)
    return tm.change_summary(tm.best_of_passes(versions), versions)


@query("pass_report", """
SELECT v.pass, count(*) AS n_texts, avg(v.score) AS mean_score,
  avg(CASE WHEN v.score < 20 THEN 1.0 ELSE 0.0 END) AS share_below,
  round(avg(v.burstiness - o.burstiness), 6) AS mean_d_burstiness,
  round(avg(v.ttr - o.ttr), 6) AS mean_d_ttr
FROM versions v JOIN versions o ON v.text_id = o.text_id AND o.pass = 0 GROUP BY v.pass
""", ("versions",))
def pass_report(spark, d):
    report = tm.pass_report(views.rewrite_versions(spark, d))
    for c in ("mean_d_burstiness", "mean_d_ttr"):
        report = report.withColumn(c, F.round(c, 6))
    return report


@query("parse_rewrite_response", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text_clean WHEN 1 THEN original WHEN 2 THEN 'no braces ' || n_chars
    ELSE '{broken ' || n_chars || '}' END AS humanized,
  CASE doc_id % 4 WHEN 0 THEN 'a;b' WHEN 1 THEN '' ELSE 'Rewrite generated' END AS changes
FROM (SELECT doc_id, n_chars, 'source ' || source AS original, 'new ' || lang || ' ' || n_chars AS text_clean
      FROM documents)
""")
def parse_rewrite_response(spark, d):
    n = F.col("n_chars").cast("string")
    raw = (
        F.when(
            F.col("doc_id") % 4 == 0,
            F.concat(F.lit('```json\nSure: {"humanized": "new '), "lang", F.lit(" "), n,
                     F.lit('", "changes": ["a", "b"]}\n```')),
        )
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"other": "'), n, F.lit('"} trailing')))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("``` no braces "), n, F.lit(" ```")))
        .otherwise(F.concat(F.lit("{broken "), n, F.lit("}")))
    )
    replies = readers.spread(readers.read_table(spark, d, "documents")).select(
        "doc_id", F.concat(F.lit("source "), "source").alias("original"), raw.alias("raw")
    )
    return tm.parse_rewrite_response(replies).select(
        "doc_id", "humanized", F.array_join("changes", ";").alias("changes")
    )

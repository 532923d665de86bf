"""Retrieval and answer quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev
from corpusloom.plans import retrieval_queries as rq
from corpusloom.plans.registry import cte, query
from corpusloom.session import materialize
from corpusloom.sources import readers, views


CUTS = (5, 10)


def per_query(spark, d):
    """Quality per question at 5 and 10; a chunk is relevant if it is judged so."""
    asked = rq.asked(spark, d).select("query_id", "label", "filter_type")
    hits = materialize(rq.hits_with(spark, d), "hits")
    # judgements of the chunks that were found: those with the question's label
    found = hits.select("query_id", "chunk_id").join(
        views.chunk_vectors(spark, d).select("chunk_id", "label"), "chunk_id")
    qrels = found.join(asked.select("query_id", "label"), ["query_id", "label"])
    judged = materialize(
        ev.judge_hits(hits, qrels).select("query_id", "rank", "relevant"), "judged")
    parts = [ev.per_query_quality(asked, judged, k).withColumn("k", F.lit(k)) for k in CUTS]
    return parts[0].unionByName(parts[1])


cte("per_query", """
SELECT q.query_id, q.label, cut.k, coalesce(q.filter_type, '') AS asked_type,
  coalesce(h.hit, 0) AS hit, coalesce(h.rr, 0) AS rr, coalesce(h.precision, 0) AS precision
FROM q CROSS JOIN (VALUES (5), (10)) cut(k) LEFT JOIN (
  SELECT query_id, cut.k, max((query_label = c.label)::INT) AS hit,
    1.0 / min(CASE WHEN query_label = c.label THEN rank END) AS rr,
    avg((query_label = c.label)::INT) AS precision
  FROM hits JOIN cv c USING (chunk_id) JOIN (VALUES (5), (10)) cut(k) ON rank <= cut.k
  GROUP BY query_id, cut.k) h ON h.query_id = q.query_id AND h.k = cut.k
""", ("q", "hits", "cv"))


@query("hit_rate_at_k", """
SELECT k, asked_type, count(*) AS n_queries, round(avg(hit), 6) AS hit_rate
FROM per_query GROUP BY k, asked_type
""", ("per_query",))
def hit_rate_at_k(spark, d):
    rows = per_query(spark, d).withColumn("asked_type", F.coalesce("filter_type", F.lit("")))
    return ev.hit_rate(rows, ["k", "asked_type"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query("mrr_at_k", """
SELECT k, label, count(*) AS n_queries, round(avg(rr), 6) AS mrr FROM per_query GROUP BY k, label
""", ("per_query",))
def mrr_at_k(spark, d):
    return ev.mrr(per_query(spark, d), ["k", "label"]).withColumn("mrr", F.round("mrr", 6))


@query("context_relevance", """
SELECT k, count(*) AS n_queries, round(avg(precision), 6) AS context_relevance FROM per_query GROUP BY k
""", ("per_query",))
def context_relevance(spark, d):
    return ev.context_relevance(per_query(spark, d), ["k"]).withColumn(
        "context_relevance", F.round("context_relevance", 6)
    )


@query("char_error_rate", """
SELECT conv_id, turn, round(levenshtein(replace(props, 'k', 'h') || '}', props) / length(props), 6) AS cer
FROM (SELECT event_id AS conv_id, user_id AS turn, props FROM events)
""")
def char_error_rate(spark, d):
    """Event payloads read with a letter mistaken and one character too many."""
    read = F.concat(F.replace("props", F.lit("k"), F.lit("h")), F.lit("}"))
    return readers.read_table(spark, d, "events").select(
        F.col("event_id").alias("conv_id"), F.col("user_id").alias("turn"),
        F.round(ev.char_error_rate(read, F.col("props")), 6).alias("cer"),
    )


@query("detection_rate", """
SELECT coalesce(d.extractor, a.extractor) AS extractor, coalesce(n_detected, 0) AS n_detected,
  coalesce(n_actual, 0) AS n_actual,
  round(coalesce(n_detected, 0) / nullif(coalesce(n_actual, 0), 0), 6) AS detection_rate
FROM (SELECT 'lang_' || lang AS extractor, count(*) AS n_detected
      FROM labels JOIN documents USING (doc_id) GROUP BY lang) d
FULL JOIN (SELECT CASE WHEN lang = 'de' THEN 'other' ELSE 'lang_' || lang END AS extractor, count(*) AS n_actual
           FROM documents GROUP BY ALL) a ON d.extractor = a.extractor
""")
def detection_rate(spark, d):
    docs = readers.read_table(spark, d, "documents").select("doc_id", "lang")
    detected = readers.read_table(spark, d, "labels").join(docs, "doc_id").select(
        F.concat(F.lit("lang_"), "lang").alias("extractor")
    )
    actual = docs.select(
        F.when(F.col("lang") == "de", "other").otherwise(F.concat(F.lit("lang_"), "lang")).alias("extractor")
    )
    return ev.detection_rate(detected, actual).withColumn("detection_rate", F.round("detection_rate", 6))


def claims(spark, d):
    """Order lines as the claims of an answer (the order); returned lines are unsupported."""
    return readers.read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("answer_id"), (F.col("l_returnflag") != "R").alias("supported")
    )


cte("faith", """
SELECT l_orderkey AS answer_id, count(*) AS n_claims, round(avg((l_returnflag <> 'R')::INT), 6) AS faithfulness,
  bool_or(l_returnflag = 'R') AS hallucinated FROM lineitem GROUP BY l_orderkey
""")


@query("faithfulness", "SELECT * FROM faith", ("faith",))
def faithfulness(spark, d):
    return ev.faithfulness(claims(spark, d)).withColumn("faithfulness", F.round("faithfulness", 6))


@query("hallucination_rate", """
SELECT count(*) AS n_answers, round(avg(hallucinated::INT), 6) AS hallucination_rate,
  round(avg(faithfulness), 4) AS mean_faithfulness FROM faith
""", ("faith",))
def hallucination_rate(spark, d):
    return ev.hallucination_rate(ev.faithfulness(claims(spark, d))).select(
        "n_answers", F.round("hallucination_rate", 6).alias("hallucination_rate"),
        F.round("mean_faithfulness", 4).alias("mean_faithfulness"),
    )


@query("answer_relevancy", """
SELECT 'label_' || label AS question_id, count(*) AS n_generated,
  round(avg(list_cosine_similarity(l.vector, c.embedding)), 6) AS answer_relevancy
FROM cv c JOIN label_q l USING (label) GROUP BY label
""", ("cv", "label_q"))
def answer_relevancy(spark, d):
    """Each label's mean vector as the question, its members as generated questions."""
    asked = materialize(views.label_questions(spark, d), "labels").select(
        F.col("query_id").alias("question_id"), "label", F.col("vector").alias("question_vector")
    )
    generated = views.chunk_vectors(spark, d).select("label", F.col("embedding").alias("generated_vector"))
    pairs = generated.join(asked, "label")
    return ev.answer_relevancy(pairs).withColumn("answer_relevancy", F.round("answer_relevancy", 6))


_tokens = """
SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split(lower({}), ' ')) AS w FROM qa)
WHERE w <> '' GROUP BY id, w"""


@query("answer_f1", f"""
, qa AS (SELECT doc_id AS id, regexp_replace(text, '\\s+', ' ', 'g') AS predicted,
  regexp_replace(regexp_replace(text, '[aA]', 'e', 'g'), '\\s+', ' ', 'g') AS truth FROM documents),
p AS ({_tokens.format('predicted')}), g AS ({_tokens.format('truth')}),
c AS (SELECT id, sum(least(p.n, g.n)) AS common FROM p JOIN g USING (id, w) GROUP BY id),
pn AS (SELECT id, sum(n) AS n FROM p GROUP BY id), gn AS (SELECT id, sum(n) AS n FROM g GROUP BY id)
SELECT qa.id, round(CASE WHEN coalesce(pn.n, 0) + coalesce(gn.n, 0) = 0 THEN 0.0
  ELSE 2.0 * coalesce(common, 0) / (coalesce(pn.n, 0) + coalesce(gn.n, 0)) END::DOUBLE, 6) AS f1
FROM qa LEFT JOIN c USING (id) LEFT JOIN pn USING (id) LEFT JOIN gn USING (id)
""".replace(", qa AS", "WITH qa AS", 1))
def answer_f1(spark, d):
    answers = readers.spread(readers.read_table(spark, d, "documents")).select(
        F.col("doc_id").alias("id"), F.col("text").alias("predicted"),
        F.regexp_replace("text", "[aA]", "e").alias("truth"),
    )
    return ev.answer_f1(answers).select("id", F.round("f1", 6).alias("f1"))


@query("citation_precision_recall", """
SELECT l_orderkey AS answer_id,
  round(count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.04) / nullif(count(*) FILTER (l_returnflag <> 'R'), 0), 6)
    AS citation_precision,
  round(count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.04) / nullif(count(*) FILTER (l_discount > 0.04), 0), 6)
    AS citation_recall
FROM lineitem GROUP BY l_orderkey
""")
def citation_precision_recall(spark, d):
    judged = readers.read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("answer_id"), F.col("l_partkey").alias("passage_id"),
        (F.col("l_returnflag") != "R").alias("cited"), (F.col("l_discount") > 0.04).alias("relevant"),
    )
    return ev.citation_precision_recall(judged).select(
        "answer_id", F.round("citation_precision", 6).alias("citation_precision"),
        F.round("citation_recall", 6).alias("citation_recall"),
    )


@query("rating_summary", """
SELECT CASE WHEN grouping(question_type) = 1 THEN '(all)' ELSE question_type END AS question_type,
  CASE WHEN grouping(dimension) = 1 THEN '(all)' ELSE dimension END AS dimension,
  count(*) AS n_ratings, round(avg(score), 6) AS mean_score
FROM ratings GROUP BY ROLLUP (question_type, dimension)
""", ("ratings",))
def rating_summary(spark, d):
    return ev.rating_summary(views.ratings(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


def latency_log(spark, d):
    return readers.read_table(spark, d, "events").select(
        F.col("event_type").alias("endpoint"), F.col("value").alias("latency_s")
    )


@query("latency_percentiles", """
SELECT event_type AS endpoint, count(*) AS n_requests, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type
""")
def latency_percentiles(spark, d):
    out = ev.latency_percentiles(latency_log(spark, d), block_width=10.0)
    return out.select("endpoint", "n_requests", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("latency_percentiles_approx", """
SELECT event_type AS endpoint, count(*) AS n_requests, true AS p50_ok, true AS p90_ok, true AS p99_ok
FROM events GROUP BY event_type
""")
def latency_percentiles_approx(spark, d):
    """The sketch's percentiles, each checked against its error bound by counting."""
    log = latency_log(spark, d)
    sketch = ev.latency_percentiles_approx(log, accuracy=1000)
    value, n = F.col("latency_s"), F.count("*")

    def holds(column: str, share: float):
        below = F.count_if(value < F.col(column)) / n <= share + 0.002
        return (below & (F.count_if(value <= F.col(column)) / n >= share - 0.002)).alias(f"{column}_ok")

    return log.join(sketch, "endpoint").groupBy("endpoint", "n_requests").agg(
        holds("p50", 0.5), holds("p90", 0.9), holds("p99", 0.99))

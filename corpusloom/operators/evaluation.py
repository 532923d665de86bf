"""Retrieval and answer quality measures over tables of hits and judgements."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import vectors
from corpusloom.operators import ordering


def judge_hits(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Add ``relevant`` from judged (query_id, chunk_id) pairs.

    Judgements can be many more than hits: they are only probed by the hits.
    """
    marked = qrels.select("query_id", "chunk_id").distinct().withColumn("_rel", F.lit(True))
    return hits.join(marked, ["query_id", "chunk_id"], "left").withColumn(
        "relevant", F.coalesce("_rel", F.lit(False))
    ).drop("_rel")


def per_query_quality(queries: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per query: hit in top k, reciprocal rank, share of relevant among retrieved.

    Queries without hits count as 0.
    """
    top = judged.where(F.col("rank") <= k)
    per_query = top.groupBy("query_id").agg(
        F.bool_or("relevant").cast("double").alias("hit"),
        (F.lit(1.0) / F.min(F.when(F.col("relevant"), F.col("rank")))).alias("rr"),
        F.avg(F.col("relevant").cast("double")).alias("precision"),
    )
    return queries.join(per_query, "query_id", "left").select(
        *queries.columns,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("hit", "rr", "precision")],
    )


def hit_rate(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), F.avg("hit").alias("hit_rate"))


def mrr(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), F.avg("rr").alias("mrr"))


def context_relevance(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(
        F.count("*").alias("n_queries"), F.avg("precision").alias("context_relevance")
    )


def char_error_rate(read: Column, truth: Column) -> Column:
    return F.levenshtein(read, truth) / F.nullif(F.length(truth), F.lit(0))


def detection_rate(detected: DataFrame, actual: DataFrame) -> DataFrame:
    """Detected over actual items per extractor, each side pre-aggregated."""
    d = detected.groupBy("extractor").agg(F.count("*").alias("n_detected"))
    a = actual.groupBy("extractor").agg(F.count("*").alias("n_actual"))
    return d.join(a, "extractor", "full").select(
        "extractor",
        F.coalesce("n_detected", F.lit(0)).alias("n_detected"),
        F.coalesce("n_actual", F.lit(0)).alias("n_actual"),
        (F.coalesce("n_detected", F.lit(0)) / F.nullif("n_actual", F.lit(0))).alias(
            "detection_rate"
        ),
    )


def faithfulness(claims: DataFrame) -> DataFrame:
    """Per answer: share of supported claims and whether any claim is unsupported."""
    return claims.groupBy("answer_id").agg(
        F.count("*").alias("n_claims"),
        F.avg(F.col("supported").cast("double")).alias("faithfulness"),
        F.bool_or(~F.col("supported")).alias("hallucinated"),
    )


def hallucination_rate(per_answer: DataFrame) -> DataFrame:
    return per_answer.agg(
        F.count("*").alias("n_answers"),
        F.avg(F.col("hallucinated").cast("double")).alias("hallucination_rate"),
        F.avg("faithfulness").alias("mean_faithfulness"),
    )


def answer_relevancy(pairs: DataFrame) -> DataFrame:
    """Mean cosine between a question and the questions generated from its answer."""
    return pairs.groupBy("question_id").agg(
        F.count("*").alias("n_generated"),
        F.avg(vectors.cosine(F.col("question_vector"), F.col("generated_vector"))).alias(
            "answer_relevancy"
        ),
    )


def answer_f1(answers: DataFrame) -> DataFrame:
    """F1 of the token multisets of ``predicted`` and ``truth``, per row.

    Both texts are in the row, so their tokens are counted there, one Arrow batch at a
    time, and nothing is shuffled.
    """
    def tokens(col: str) -> Column:
        parts = F.split(F.lower(F.coalesce(col, F.lit(""))), tx.SPACES)
        return F.filter(parts, lambda t: t != "")

    @F.pandas_udf("common long, n_predicted long, n_truth long")
    def count(predicted: pd.Series, truth: pd.Series) -> pd.DataFrame:
        common = [
            sum((Counter(p.tolist()) & Counter(t.tolist())).values())
            for p, t in zip(predicted, truth, strict=True)
        ]
        return pd.DataFrame({
            "common": common, "n_predicted": predicted.map(len), "n_truth": truth.map(len)
        })

    counted = answers.withColumn("_c", count(tokens("predicted"), tokens("truth")))
    total = F.col("_c.n_predicted") + F.col("_c.n_truth")
    return counted.select(
        "id", "_c.common", "_c.n_predicted", "_c.n_truth",
        F.when(total > 0, 2.0 * F.col("_c.common") / total).otherwise(0.0).alias("f1"),
    )


def citation_precision_recall(judged: DataFrame) -> DataFrame:
    """Per answer from ``(answer_id, passage_id, cited, relevant)``."""
    both = F.count_if(F.col("cited") & F.col("relevant"))
    return judged.groupBy("answer_id").agg(
        (both / F.nullif(F.count_if("cited"), F.lit(0))).alias("citation_precision"),
        (both / F.nullif(F.count_if("relevant"), F.lit(0))).alias("citation_recall"),
    )


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Mean 1-5 rating per question type x dimension, with subtotals and the overall mean.

    Subtotals are named by ``(all)``; a missing type or dimension stays NULL.
    """
    summed = ratings.rollup("question_type", "dimension").agg(
        F.count("*").alias("n_ratings"), F.avg("score").alias("mean_score"),
        F.grouping("question_type").alias("_all_types"), F.grouping("dimension").alias("_all_dims"),
    )
    return summed.select(
        F.when(F.col("_all_types") == 1, "(all)").otherwise(F.col("question_type"))
        .alias("question_type"),
        F.when(F.col("_all_dims") == 1, "(all)").otherwise(F.col("dimension")).alias("dimension"),
        "n_ratings",
        "mean_score",
    )


def latency_percentiles(
    log: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.99), block_width: float = 1.0
) -> DataFrame:
    """Exact interpolated percentiles per endpoint.

    Equal latencies are counted before the shuffle; positions come from a two-level
    running total over the distinct values, so no endpoint is held in one buffer.
    """
    counts = log.groupBy("endpoint", "latency_s").agg(F.count("*").alias("n"))
    ranked = ordering.running_total(
        counts, ["endpoint"], F.floor(F.col("latency_s") / block_width), ["latency_s"],
        F.col("n"), "upto",
    )
    totals = counts.groupBy("endpoint").agg(F.sum("n").alias("total"))
    placed = ranked.join(totals, "endpoint")

    def value_at(position: Column) -> Column:
        inside = (F.col("upto") > position) & (F.col("upto") - F.col("n") <= position)
        return F.max(F.when(inside, F.col("latency_s")))

    aggs = [F.max("total").alias("n_requests")]
    for share in shares:
        at = (F.col("total") - 1) * F.lit(float(share))
        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        weight = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * weight).alias(f"p{round(share * 100)}"))
    return placed.groupBy("endpoint").agg(*aggs)


def latency_percentiles_approx(
    log: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.99), accuracy: int = 10000
) -> DataFrame:
    """Mergeable sketch variant: one pass, bounded memory."""
    return log.groupBy("endpoint").agg(
        F.count("*").alias("n_requests"),
        *[
            F.percentile_approx("latency_s", float(s), accuracy).alias(f"p{round(s * 100)}")
            for s in shares
        ],
    )


def ann_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact top-k that the approximate search also returned, per query."""
    found = approximate.select("query_id", "chunk_id").withColumn("_found", F.lit(1.0))
    return (
        exact.join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("_found", F.lit(0.0))).alias("recall"))
    )

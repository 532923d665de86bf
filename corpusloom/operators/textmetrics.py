"""Writing-style metrics and the transparent machine-text score, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.numbers import round_exact

# Marker patterns, target and pass limit.
EM_DASH = "—"
PARENTHETICAL = r"\([^)]+\)"
OPENING_WORD = rf"(?i)^(but|and|so|yet)({tx.NON_WORD}|$)"
CONTRACTION = rf"(?i){tx.WORD}'(s|t|re|ve|ll|d|m)({tx.NON_WORD}|$)"
TARGET_SCORE = 20
MAX_PASSES = 3

METRIC_COLUMNS = [
    "word_count", "sentence_count", "avg_sent_len", "std_dev", "burstiness", "ttr",
    "human_markers", "has_em_dash", "has_parenthetical", "starts_with_but_and",
    "has_contractions",
]


def text_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the metric columns; all of them are NULL for blank text.

    One projection per step keeps shared sub-results (sentence array, lengths) computed
    once per row; there is no shuffle.
    """
    body = F.when(tx.has_text(F.col(text_col)), F.col(text_col))
    words = F.split(F.trim("_flat"), " ")
    letters = F.regexp_replace(F.lower("_flat"), "[^a-z ]+", "")
    step = (
        df.withColumn("_body", body)
        # One space for every run of whitespace: from here on words split at " ".
        .withColumn("_flat", F.regexp_replace("_body", tx.SPACES, " "))
        .withColumn("_sents", tx.sentences(F.col("_flat")))
        .withColumn(
            "_lens", F.transform("_sents", lambda s: F.size(F.split(F.trim(s), " ")).cast("double"))
        )
        .withColumn("_terms", F.filter(F.split(letters, " "), lambda w: w != ""))
        .withColumn("word_count", F.when(F.col("_body").isNotNull(), F.size(words)))
        .withColumn(
            "sentence_count", F.when(F.col("_body").isNotNull(), F.size("_sents"))
        )
        .withColumn(
            "_mean",
            F.aggregate("_lens", F.lit(0.0), lambda a, x: a + x) / F.col("sentence_count"),
        )
    )
    step = step.withColumn(
        "_std",
        F.sqrt(
            F.aggregate(
                "_lens",
                F.lit(0.0),
                lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")),
            )
            / F.col("sentence_count")
        ),
    ).withColumn(
        "_ttr",
        F.size(F.array_distinct("_terms")).cast("double") / F.greatest(F.size("_terms"), F.lit(1)),
    )
    blank = F.col("_body").isNull()
    step = (
        step.withColumn("avg_sent_len", round_exact(F.col("_mean"), 1))
        .withColumn("std_dev", round_exact(F.col("_std"), 1))
        .withColumn(
            "burstiness",
            round_exact(
                F.col("_std") / F.when(F.col("_mean") == 0, 1.0).otherwise(F.col("_mean")), 2
            ),
        )
        .withColumn("ttr", F.when(~blank, round_exact(F.col("_ttr"), 2)))
        .withColumn("has_em_dash", F.col("_body").contains(EM_DASH))
        .withColumn(
            "has_parenthetical", F.col("_body").contains("(") & F.col("_body").rlike(PARENTHETICAL)
        )
        .withColumn(
            "starts_with_but_and",
            F.when(~blank, F.size(F.filter("_sents", lambda s: s.rlike(OPENING_WORD)))),
        )
        .withColumn(
            "has_contractions", F.col("_body").contains("'") & F.col("_body").rlike(CONTRACTION)
        )
        .withColumn(
            "human_markers",
            F.col("has_em_dash").cast("int")
            + F.col("has_parenthetical").cast("int")
            + (F.col("starts_with_but_and") > 0).cast("int")
            + F.col("has_contractions").cast("int"),
        )
    )
    return step.drop("_body", "_flat", "_sents", "_lens", "_terms", "_mean", "_std", "_ttr")


def heuristic_score() -> Column:
    """0-100 score from the rounded metric columns; 0 when the metrics are NULL."""
    # Thresholds and weights.
    b, length, ttr = F.col("burstiness"), F.col("avg_sent_len"), F.col("ttr")
    by_burstiness = (
        F.when(b < 0.3, 25).when(b < 0.5, 12).when(b > 0.8, -25).when(b > 0.6, -18).otherwise(-8)
    )
    by_length = (
        F.when(length.between(19, 26), 12).when((length < 12) | (length > 30), -10).otherwise(0)
    )
    by_ttr = F.when(ttr < 0.45, 10).when(ttr > 0.7, -15).when(ttr > 0.6, -8).otherwise(0)
    total = F.lit(50) + by_burstiness + by_length + by_ttr - F.col("human_markers") * 8
    return F.when(
        F.col("word_count").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), total))
    ).otherwise(0)


def blend_score(heuristic: Column, detector: Column) -> Column:
    """60 % heuristic, 40 % detector (50 when missing), to the nearest integer."""
    mixed = heuristic * F.lit(0.6) + F.coalesce(detector, F.lit(50.0)) * F.lit(0.4)
    return round_exact(mixed, 0)


def score_texts(df: DataFrame, text_col: str = "text", detector_col: str | None = None) -> DataFrame:
    """Metrics plus heuristic_score, ai_percentage and confidence."""
    detector = F.col(detector_col) if detector_col else F.lit(None).cast("double")
    return (
        text_metrics(df, text_col)
        .withColumn("heuristic_score", heuristic_score())
        .withColumn("detector_score", F.coalesce(detector, F.lit(50.0)))
        .withColumn("ai_percentage", blend_score(F.col("heuristic_score"), detector))
        .withColumn("confidence", F.when(F.col("word_count") >= 50, 0.85).otherwise(0.6))
    )


def verdict(score: Column, high: float = 70, low: float = 40) -> Column:
    return F.when(score > high, "ai").when(score > low, "mixed").otherwise("human")


def _plain(x: Column) -> Column:
    """A rounded double the way it is shown to readers (0.5, 12.0)."""
    return x.cast("string")


def explanation(high: float = 70, low: float = 40) -> Column:
    """Readable account of a scored row; needs the columns of ``score_texts``."""
    # Wording and cut-offs.
    score = F.col("ai_percentage").cast("int")
    b, length, ttr = F.col("burstiness"), F.col("avg_sent_len"), F.col("ttr")
    head = (
        F.when(score > high, F.format_string("**Verdict:** Likely AI-generated (%d%% probability).", score))
        .when(score > low, F.format_string("**Verdict:** Mixed signals (%d%% AI probability).", score))
        .otherwise(
            F.format_string(
                "**Verdict:** Likely human-written (%d%% confidence).", F.lit(100) - score
            )
        )
    )
    burst = F.concat(
        F.lit("\n**Burstiness:** "), _plain(b),
        F.when(b >= 0.5, " (human-like variance ✓)")
        .when(b < 0.3, " (too uniform - AI marker ✗)")
        .otherwise(" (moderate)"),
    )
    diversity = F.concat(
        F.lit("**Lexical Diversity:** "), _plain(ttr),
        F.when(ttr >= 0.6, " (rich vocabulary ✓)")
        .when(ttr < 0.45, " (repetitive - AI marker ✗)")
        .otherwise(" (moderate)"),
    )
    sentence = F.concat(
        F.lit("**Avg Sentence Length:** "), _plain(length),
        F.when(length.between(19, 26), " words (in AI sweet spot 19-26 ✗)").otherwise(
            " words (outside AI range ✓)"
        ),
    )
    named = F.concat_ws(
        ", ",
        F.when(F.col("has_em_dash"), "em-dashes"),
        F.when(F.col("has_parenthetical"), "parentheticals"),
        F.when(F.col("has_contractions"), "contractions"),
        F.when(F.col("starts_with_but_and") > 0, "varied sentence starts"),
    )
    markers = F.when(
        F.col("human_markers") > 0,
        F.concat(F.lit("**Human markers detected:** "), named, F.lit(" ✓")),
    ).otherwise("**Human markers:** None detected ✗")
    parts = F.concat(
        F.lit("\n**Component scores:** Heuristic="), F.col("heuristic_score").cast("string"),
        F.lit("%, RoBERTa="), round_exact(F.col("detector_score"), 0).cast("int").cast("string"),
        F.lit("%"),
    )
    return F.when(
        F.col("word_count").isNotNull(),
        F.concat_ws("\n", head, burst, diversity, sentence, markers, parts),
    ).otherwise("Unable to analyze text.")


# ----------------------------------------------------------------- rewrite versions


def best_of_passes(
    versions: DataFrame, target: float = TARGET_SCORE, max_passes: int = MAX_PASSES
) -> DataFrame:
    """Best version per text among pass 0 (the original) and the passes actually run.

    Passes run up to the first one (>= 1) that reaches the target. A text has at most
    ``max_passes`` + 1 versions, and window and aggregation share one shuffle by text.
    """
    reached = F.when((F.col("pass") >= 1) & (F.col("score") <= target), F.col("pass"))
    used = (
        versions.where(F.col("pass") <= max_passes)
        .withColumn("_hit", F.min(reached).over(Window.partitionBy("text_id")))
        .where(F.col("pass") <= F.coalesce("_hit", F.lit(max_passes)))
    )
    return used.groupBy("text_id").agg(
        F.min_by("pass", F.struct("score", "pass")).alias("best_pass"),
        F.min("score").alias("best_score"),
        F.max(F.when(F.col("pass") == 0, F.col("score"))).alias("original_score"),
        F.max("pass").alias("passes_used"),
        (F.min("score") <= target).alias("target_reached"),
    )


def change_summary(best: DataFrame, versions: DataFrame, target: float = TARGET_SCORE) -> DataFrame:
    """Readable summary of what the best version improved, with up to six distinct changes.

    ``versions`` has metrics and ``changes ARRAY<STRING>`` per (text_id, pass).
    """
    # Wording.
    # Both sides grow alike, so neither may be broadcast, whatever its estimate.
    picked = best.hint("merge").join(versions, "text_id").where(
        F.col("pass") <= F.col("passes_used"))
    cols = ["burstiness", "ttr", "human_markers"]
    grouped = picked.groupBy("text_id").agg(
        F.first("original_score").alias("before"),
        F.first("best_score").alias("after"),
        F.first("passes_used").alias("passes_used"),
        F.first("target_reached").alias("target_reached"),
        *[F.max(F.when(F.col("pass") == 0, F.col(c))).alias(f"{c}_0") for c in cols],
        *[F.max(F.when(F.col("pass") == F.col("best_pass"), F.col(c))).alias(f"{c}_1") for c in cols],
        F.slice(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.array_sort(
                            F.collect_list(
                                F.when(F.col("pass") >= 1, F.struct("pass", "changes"))
                            )
                        ),
                        lambda p: p["changes"],
                    )
                )
            ),
            1,
            6,
        ).alias("_changes"),
    )

    def improved(col: str, label: str, tail: str) -> Column:
        return F.when(
            F.col(f"{col}_1") > F.col(f"{col}_0"),
            F.concat(
                F.lit(f"✓ {label}: "), F.col(f"{col}_0").cast("string"), F.lit(" → "),
                F.col(f"{col}_1").cast("string"), F.lit(tail),
            ),
        )

    def whole(col: str) -> Column:
        return F.col(col).cast("int").cast("string")

    banner = F.when(
        F.col("target_reached"),
        F.concat(
            F.lit("✅ **Target reached!** AI score: "), whole("before"), F.lit("% → **"),
            whole("after"), F.lit("%** in "), whole("passes_used"), F.lit(" pass"),
            F.when(F.col("passes_used") > 1, "es").otherwise(""),
        ),
    ).otherwise(
        F.concat(
            F.lit("⚠ **Best result after "), whole("passes_used"), F.lit(" passes:** "),
            whole("before"), F.lit("% → **"), whole("after"),
            F.lit(f"%** (target was <{target:g}%)"),
        )
    )
    return grouped.select(
        "text_id",
        F.concat_ws(
            "\n",
            banner,
            F.lit("\n**Metric Changes:**"),
            improved("burstiness", "Burstiness", " (more sentence variety)"),
            improved("ttr", "Lexical diversity", " (richer vocabulary)"),
            improved("human_markers", "Human markers", ""),
            F.when(F.size("_changes") > 0, "\n**Specific Changes Made:**"),
            F.when(
                F.size("_changes") > 0,
                F.array_join(F.transform("_changes", lambda c: F.concat(F.lit("• "), c)), "\n"),
            ),
        ).alias("summary"),
    )


def parse_rewrite_response(df: DataFrame, raw: str = "raw", original: str = "original") -> DataFrame:
    """Rewritten text and reported changes from a raw model reply.

    Code fences are removed and the JSON object between the first and the last brace is
    read; without readable JSON the cleaned reply is the text, with one stock change.
    """
    # Field names and the stock change.
    cleaned = tx.strip(F.regexp_replace(F.col(raw), "```(json)?", ""))
    step = df.withColumn("_clean", cleaned).withColumn(
        "_json", F.from_json(
            F.nullif(F.regexp_extract("_clean", r"(?s)\{.*\}", 0), F.lit("")),
            "humanized string, changes array<string>, _bad string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        )
    )
    ok = F.col("_json").isNotNull() & F.col("_json._bad").isNull()
    return (
        step.withColumn(
            "humanized",
            F.when(ok, F.coalesce("_json.humanized", F.col(original))).otherwise(F.col("_clean")),
        )
        .withColumn(
            "changes",
            F.when(ok, F.coalesce("_json.changes", F.array().cast("array<string>"))).otherwise(
                F.array(F.lit("Rewrite generated"))
            ),
        )
        .drop("_clean", "_json")
    )


def pass_report(versions: DataFrame, threshold: float = TARGET_SCORE) -> DataFrame:
    """Per pass: mean score, share below the threshold, mean change against the original."""
    original = versions.where(F.col("pass") == 0).select(
        "text_id", F.col("burstiness").alias("_b0"), F.col("ttr").alias("_t0")
    )
    return (
        versions.join(original.hint("merge"), "text_id")  # grows with the versions: no broadcast
        .groupBy("pass")
        .agg(
            F.count("*").alias("n_texts"),
            F.avg("score").alias("mean_score"),
            F.avg((F.col("score") < threshold).cast("double")).alias("share_below"),
            F.avg(F.col("burstiness") - F.col("_b0")).alias("mean_d_burstiness"),
            F.avg(F.col("ttr") - F.col("_t0")).alias("mean_d_ttr"),
        )
    )

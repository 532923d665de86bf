"""The operators as named queries over the given tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    ann,
    hardneg,
    langid,
    lexical,
    lines,
    lm,
    maxscore,
    mixing,
    near,
    packing,
    sharding,
    sigtree,
    textops,
    tokens,
)

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", "text")


def near_documents(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(_table(spark, folder, "documents"), words=2)


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(_table(spark, folder, "embeddings"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_id(_table(spark, folder, "documents"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(
        _table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def shard(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.top_k(_table(spark, folder, "embeddings"))


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(_table(spark, folder, "documents"))


def mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents"))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return sigtree.jaccard_join(_table(spark, folder, "documents"), words=4, percent=85)


def mine_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": pack,
    "op2_line_dedup": fuzzy_lines,
    "op3_near_duplicates": near_documents,
    "op4_adaptive_scan": nearest,
    "op5_language_id": languages,
    "op6_token_counts": token_counts,
    "op7_sharding": shard,
    "op8_maxscore": exact_top_k,
    "op9_recurrent_scores": model_scores,
    "op10_mixing": mix,
    "op11_lexical_search": lexical_search,
    "op12_jaccard_join": jaccard,
    "op13_hard_negatives": mine_negatives,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def _lowered(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def all_sql() -> dict[str, str]:
    size = sharding.TABLE_SIZE
    owners = sharding.lookup_table(SHARDS, size)
    slot = (
        "(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
        f" % {size})::INTEGER"
    )
    part = "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL"
    return {
        "op8_maxscore": f"""
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
  FROM embeddings {part}),
good AS (
  SELECT vec_id FROM parts GROUP BY vec_id
  HAVING count(x) = count(*) AND bool_and(isfinite(x))),
terms AS (
  SELECT p.vec_id, d, floor(1024 * p.x::DOUBLE)::BIGINT AS v
  FROM parts p JOIN good USING (vec_id)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score
  FROM terms q JOIN terms c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scores) WHERE rank <= 10""",
        "op11_lexical_search": f"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all({_lowered('text')}, '{lexical.TERM_PATTERN}')) AS term
  FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals GROUP BY term, docs),
lengths AS (
  SELECT doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM sizes, totals),
asked AS (
  SELECT item_id, unnest(regexp_extract_all({_lowered('text')}, '{lexical.TERM_PATTERN}')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id)
  GROUP BY ALL)
SELECT item_id,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
  doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20""",
        "op12_jaccard_join": f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_lowered('text')}, '{textops.WORD_PATTERN}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) END) AS s
  FROM texts WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM texts
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT t.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b)::BIGINT AS component_id
FROM texts t JOIN reached ON t.doc_id = a LEFT JOIN sizes s ON t.doc_id = s.doc_id
GROUP BY t.doc_id""",
        "op13_hard_negatives": """
WITH parts AS (
  SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list(floor(256 * x::DOUBLE) ORDER BY d) AS v
  FROM parts GROUP BY ALL HAVING count(x) = count(*) AND bool_and(isfinite(x))),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER
    AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
        "op7_sharding": f"SELECT doc_id, slot, ({owners})[slot + 1]::INTEGER AS shard "
        f"FROM (SELECT doc_id, {slot} AS slot FROM documents)",
    }

"""Queries of keyword search, fusion, diversity, the question cache and citation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import cache, keyword, rerank, retrieval, verification
from corpusloom.plans import retrieval_queries as rq
from corpusloom.plans.registry import cte, query
from corpusloom.session import materialize, new_table_path
from corpusloom.sources import readers, views


def bm25(questions: str, chunks: str, k: int) -> str:
    """BM25 over exploded terms, every chunk scored."""
    def found(x: str) -> str:
        return f"regexp_extract_all(lower({x}), '{keyword.TERM_PATTERN}')"

    k1, b = keyword.K1, keyword.B
    return f"""
    SELECT query_id, chunk_id, points / 1000000.0::DOUBLE AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS rank
      FROM (
        SELECT query_id, chunk_id, sum(times * floor(1000000::DOUBLE * (weight * part)))::BIGINT
          AS points
        FROM (
          SELECT query_id, term, count(*) AS times
          FROM (SELECT query_id, unnest({found('question')}) AS term FROM {questions})
          GROUP BY query_id, term) a
        JOIN (
          SELECT *, tf * {k1 + 1}::DOUBLE
              / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * (n::DOUBLE / mean))) AS part,
            ln(1.0::DOUBLE + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS weight
          FROM (
            SELECT *, count(*) OVER (PARTITION BY term) AS df
            FROM (
              SELECT chunk_id, term, any_value(n) AS n, count(*) AS tf
              FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term
                    FROM (SELECT chunk_id, {found('content')} AS t FROM {chunks}))
              GROUP BY chunk_id, term)),
            (SELECT count(*) AS total, sum(len(t))::DOUBLE / count(*) AS mean
             FROM (SELECT {found('content')} AS t FROM {chunks}) WHERE len(t) > 0)) p
        USING (term) GROUP BY query_id, chunk_id)
      WHERE points > 0) WHERE rank <= {k}"""


cte("items", "SELECT 'item_' || item_id AS query_id, text AS question FROM benchmark")
cte("text_q", """
SELECT q.*, text AS question FROM q LEFT JOIN benchmark
  ON item_id = (label + 10 * CAST(substr(source_file, 7) AS INTEGER)) % (SELECT count(*) FROM benchmark)
""", ("q",))
cte("keyword_hits", bm25("text_q", "cvt", 10), ("text_q", "cvt"))


@query("bm25_search", bm25("items", "doc_chunks", 10), ("items", "doc_chunks"))
def bm25_search(spark, d):
    """Benchmark passages as questions over all lines of the documents."""
    index = keyword.build_index(views.doc_chunks(spark, d))
    questions = readers.read_table(spark, d, "benchmark").select(
        F.concat(F.lit("item_"), "item_id").alias("query_id"), F.col("text").alias("question"))
    return keyword.bm25_search(index, questions, 10)


def text_questions(spark, d):
    """The questions with vectors, each with a benchmark passage as its text."""
    items = readers.read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    number = F.substring("source_file", 7, 10).cast("long")
    return rq.asked(spark, d).withColumn(
        "item_id", (F.col("label") + 10 * number) % items.count()).join(items, "item_id", "left")


def both_hits(spark, d):
    """(vector hits, keyword hits) of the same questions over the same chunks."""
    questions = materialize(text_questions(spark, d), "text-questions")
    plain = questions.select("query_id", "vector")
    near = retrieval.knn_exact(plain, views.chunk_vectors(spark, d), 10)
    index = keyword.build_index(views.chunks_with_text(spark, d))
    found = keyword.bm25_search(index, questions, 10)
    return materialize(near, "vector-hits"), materialize(found, "keyword-hits")


_sides = """
SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.chunk_id, w.chunk_id) AS chunk_id,
  v.score AS vs, w.score AS ws, v.rank AS vector_rank, w.rank AS keyword_rank
FROM hits_plain v FULL JOIN keyword_hits w ON v.query_id = w.query_id AND v.chunk_id = w.chunk_id
"""


def _stretched(column: str) -> str:
    low, high = (f"{f}({column}) OVER (PARTITION BY query_id)" for f in ("min", "max"))
    return (f"CASE WHEN {high} > {low} THEN ({column} - {low}) / ({high} - {low}) "
            f"WHEN {column} IS NOT NULL THEN 1.0::DOUBLE END")


@query("hybrid_search", f"""
, sides AS ({_sides}), fused AS (
  SELECT 'ranks' AS method, *, round(coalesce(0.7::DOUBLE / (60 + vector_rank), 0)
    + coalesce((1 - 0.7::DOUBLE) / (60 + keyword_rank), 0), 9) AS score FROM sides
  UNION ALL
  SELECT 'scores' AS method, *, round(coalesce(0.7::DOUBLE * ({_stretched('vs')}), 0)
    + coalesce((1 - 0.7::DOUBLE) * ({_stretched('ws')}), 0), 6) AS score FROM sides)
SELECT * EXCLUDE (vs, ws) FROM (
  SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, chunk_id) AS rank
  FROM fused) WHERE rank <= 10
""", ("hits_plain", "keyword_hits"))
def hybrid_search(spark, d):
    """Keyword and vector hits fused by rank and by score; one-sided hits are kept."""
    near, found = both_hits(spark, d)
    return rerank.fuse_ranks(near, found).select(F.lit("ranks").alias("method"), "*").unionByName(
        rerank.fuse_scores(near, found).select(F.lit("scores").alias("method"), "*"))


CANDIDATES = 30

cte("wide_hits", f"""
SELECT h.query_id, h.chunk_id, h.score, h.rank, embedding, round(h.score * 1000000)::BIGINT AS s
FROM (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM (SELECT q.query_id, c.chunk_id,
            round((1 + list_cosine_similarity(q.vector, c.embedding)) / 2, 6) AS score
          FROM q, cv c WHERE c.embedding IS NOT NULL)) WHERE rank <= {CANDIDATES}) h
JOIN cv USING (chunk_id)
""", ("q", "cv"))


@query("mmr_hits", """
SELECT query_id, chunk_id, score, rank, position FROM (
  WITH RECURSIVE likes AS (
    SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y,
      round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2 * 1000000)::BIGINT AS l
    FROM wide_hits a JOIN wide_hits b USING (query_id)),
  picks AS (
    SELECT query_id, 1 AS step, [min({'v': -70 * s, 'id': chunk_id}).id] AS picked
    FROM wide_hits GROUP BY query_id
    UNION ALL
    SELECT query_id, step + 1, list_append(any_value(picked), min({'v': -value, 'id': chunk_id}).id)
    FROM (
      SELECT p.query_id, p.step, p.picked, h.chunk_id, 70 * any_value(h.s) - 30 * max(l) AS value
      FROM picks p JOIN wide_hits h ON p.query_id = h.query_id AND NOT list_contains(p.picked, h.chunk_id)
      JOIN likes k ON k.query_id = p.query_id AND k.y = h.chunk_id AND list_contains(p.picked, k.x)
      WHERE p.step < 10
      GROUP BY p.query_id, p.step, p.picked, h.chunk_id)
    GROUP BY query_id, step)
  SELECT query_id, unnest(picked) AS chunk_id,
    generate_subscripts(picked, 1)::INTEGER AS position
  FROM (SELECT query_id, arg_max(picked, step) AS picked FROM picks GROUP BY query_id)
) JOIN wide_hits USING (query_id, chunk_id)
""", ("wide_hits",))
def mmr_hits(spark, d):
    """Ten of thirty hits per question, no two alike if it can be helped."""
    chunks = views.chunk_vectors(spark, d)
    hits = retrieval.knn_exact(rq.plain_asked(spark, d), chunks, CANDIDATES)
    return rerank.mmr(materialize(hits, "wide-hits"), chunks)


# --------------------------------------------------------------- cache and citations


@query("cache_lookup", """
WITH turned AS (
  SELECT 'n' || vec_id AS query_id, list_transform(e, lambda x, i: x + (vec_id % 7) * 0.07::DOUBLE * e[len(e) + 1 - i])
    AS vector
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
met AS (
  SELECT query_id, 'p' || vec_id AS cached_id,
    round((1 + list_cosine_similarity(vector, embedding::DOUBLE[])) / 2, 6) AS score
  FROM turned, embeddings)
SELECT t.query_id, cached_id, score, cached_id IS NOT NULL AS hit FROM turned t LEFT JOIN (
  SELECT * FROM met WHERE score >= 0.975
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cached_id) = 1) m
ON t.query_id = m.query_id
""")
def cache_lookup(spark, d):
    """Past questions: the vectors; new ones: the same, each turned by its own angle."""
    rows = readers.read_table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    past = rows.select(F.concat(F.lit("p"), "vec_id").alias("query_id"), F.col("e").alias("vector"))
    share = (F.col("vec_id") % 7) * 0.07
    new = rows.select(
        F.concat(F.lit("n"), "vec_id").alias("query_id"),
        F.zip_with("e", F.reverse("e"), lambda x, y: x + share * y).alias("vector"))
    store = cache.build_cache(past, new_table_path(spark, "question-cache"))
    return cache.cache_lookup(store, new)


cte("cited", """
SELECT 'a_' || label || '_' || source_file AS answer_id, string_agg(
  'Claim ' || vec_id || ' [Source: ' || CASE WHEN vec_id % 6 = 1 THEN 'ghost_' ELSE '' END || source_file
  || ', Page ' || CASE vec_id % 6 WHEN 2 THEN page_number + 1000 WHEN 3 THEN 0 ELSE page_number END
  || CASE WHEN vec_id % 6 = 4 THEN ', Section Nowhere' WHEN section_heading <> ''
     THEN ', Section ' || section_heading ELSE '' END || '].', ' ' ORDER BY vec_id) AS text
FROM cv GROUP BY label, source_file
""", ("cv",))


def cited_answers(spark, d):
    """Answers that cite every chunk, some with a wrong file, page or section."""
    turn = F.substring("chunk_id", 2, 18).cast("long") % 6
    claim = F.concat(
        F.lit("Claim "), F.substring("chunk_id", 2, 18), F.lit(" [Source: "),
        F.when(turn == 1, "ghost_").otherwise(""), "source_file", F.lit(", Page "),
        F.when(turn == 2, F.col("page_number") + 1000).when(turn == 3, 0)
        .otherwise(F.col("page_number")),
        F.when(turn == 4, ", Section Nowhere").when(
            F.col("section_heading") != "", F.concat(F.lit(", Section "), "section_heading"))
        .otherwise(""), F.lit("]."))
    number = F.substring("chunk_id", 2, 18).cast("long")
    return views.chunk_vectors(spark, d).groupBy("label", "source_file").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(number.alias("n"), claim.alias("text")))),
            lambda c: c["text"]), " ").alias("text")).select(
        F.concat(F.lit("a_"), "label", F.lit("_"), "source_file").alias("answer_id"), "text")


@query("citation_check", r"""
, runs AS (
  SELECT *, row_number() OVER o AS section_no, page_number AS first_page,
    coalesce(lead(page_number) OVER o, last_of_file) AS last_page
  FROM (SELECT source_file, section_heading, page_number, chunk_index, chunk_id,
          lag(section_heading) OVER (PARTITION BY source_file ORDER BY page_number, chunk_index, chunk_id) AS before,
          max(page_number) OVER (PARTITION BY source_file) AS last_of_file FROM cv)
  WHERE before IS NULL OR before <> section_heading
  WINDOW o AS (PARTITION BY source_file ORDER BY page_number, chunk_index, chunk_id)),
parts AS (
  SELECT answer_id, unnest(c) AS c, generate_subscripts(c, 1)::INTEGER AS citation_no
  FROM (SELECT answer_id, regexp_extract_all(text, '\[Source: [^\]]*\]') AS c FROM cited)),
cites AS (
  SELECT answer_id, citation_no, regexp_extract(c, 'Source: ([^,]+)', 1) AS source_file,
    regexp_extract(c, 'Page (\d+)', 1)::INTEGER AS page_number,
    nullif(regexp_extract(c, 'Section ([^\]]+)', 1), '') AS section_heading FROM parts),
judged AS (
  SELECT c.*, pages IS NOT NULL AS file_exists,
    coalesce(c.page_number BETWEEN 1 AND pages, false) AS page_valid,
    (SELECT bool_or(r.section_heading = c.section_heading) FROM runs r
     WHERE r.source_file = c.source_file AND c.page_number BETWEEN first_page AND last_page) AS named,
    coalesce(
      (SELECT arg_max(r.section_heading, section_no) FROM runs r
       WHERE r.source_file = c.source_file AND r.first_page < c.page_number),
      (SELECT arg_min(r.section_heading, section_no) FROM runs r
       WHERE r.source_file = c.source_file AND r.first_page = c.page_number)) AS force
  FROM cites c LEFT JOIN (SELECT source_file, max(page_number) AS pages FROM cv GROUP BY source_file) f
    ON f.source_file = c.source_file)
SELECT answer_id, citation_no, source_file, page_number, section_heading, file_exists, page_valid,
  page_valid AND (section_heading IS NULL OR coalesce(named, false)) AS section_on_page,
  CASE WHEN page_valid THEN force END AS in_force,
  CASE WHEN NOT file_exists THEN 'unknown file' WHEN NOT page_valid THEN 'no such page'
    WHEN section_heading IS NOT NULL AND NOT coalesce(named, false) THEN 'section not on page'
    ELSE 'valid' END AS verdict
FROM judged
""", ("cited", "cv"))
def citation_check(spark, d):
    chunks = views.chunk_vectors(spark, d)
    files = chunks.groupBy("source_file").agg(F.max("page_number").alias("total_pages"))
    cited = verification.parse_citations(cited_answers(spark, d))
    return verification.check_citations(
        materialize(cited, "citations"), files, verification.section_spans(chunks))

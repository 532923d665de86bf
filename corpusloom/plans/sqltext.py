"""SQL twins of the derived views, as named common table expressions."""

from __future__ import annotations

from corpusloom.functions import text as tx
from corpusloom.functions.numbers import round_exact_sql
from corpusloom.operators import elements, tasks
from corpusloom.plans.registry import cte


# Whitespace spelled out, because \\s is ASCII only in this engine.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def has_text(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{SPACE}]'), false)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda w: w <> '')"


def letters_only(x: str) -> str:
    return words(f"regexp_replace(lower({x}), '[^a-z{SPACE}]', '', 'g')")


def fixed2(x: str) -> str:
    return f"printf('%.2f', {round_exact_sql(x, 2)})"


def is_heading(text: str, size: str) -> str:
    keys = "|".join(elements.HEADING_KEYWORDS)
    plain = strip(f"lower({text})")
    return (
        f"(regexp_matches({plain}, '^({keys})(:|$)') "
        f"OR regexp_matches(regexp_replace({plain}, '^[0-9. ]+', ''), '^({keys})(:|$)') "
        f"OR ({size} >= 14 AND length({text}) < 100))"
    )


# ----------------------------------------------------------------- vectors and queries

cte("cvt", """
SELECT *, CASE WHEN content_type = 'text' THEN 'paragraph' ELSE content_type END AS element_type,
  CASE WHEN content_type = 'figure' OR (content_type <> 'text' AND vec_id % 5 = 0)
    THEN 'store/fig_' || vec_id || '.png' ELSE '' END AS image_path,
  CASE WHEN content_type = 'figure' THEN 'figure ' || vec_id END AS image_description,
  CASE WHEN content_type = 'equation' THEN 'x_{' || vec_id || '}' END AS latex_source
FROM (
  SELECT vec_id, 'v' || vec_id AS chunk_id, 'paper_' || (vec_id // 100) AS source_file,
    CAST((vec_id % 100) // 8 + 1 AS INTEGER) AS page_number,
    CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'S' || (vec_id % 5) END AS section_heading,
    vec_id % 100 AS chunk_index,
    ['text', 'table', 'figure', 'equation'][(vec_id // 7) % 4 + 1] AS content_type,
    embedding::DOUBLE[] AS embedding, label, content
  FROM (SELECT coalesce(vec_id, doc_id) AS vec_id, embedding, label, text AS content
        FROM embeddings FULL JOIN documents ON vec_id = doc_id))
""")
cte("cv", "SELECT * EXCLUDE (content) FROM cvt WHERE embedding IS NOT NULL", ("cvt",))
cte("label_q", """
SELECT 'label_' || label AS query_id, label, list(x ORDER BY i) AS vector FROM (
  SELECT label, i, avg(x) AS x FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM cv)
  GROUP BY label, i) GROUP BY label
""", ("cv",))
cte("q", """
SELECT 'q_' || label || '_' || source_file AS query_id, label, source_file, vector,
  CASE WHEN label % 4 >= 2 THEN source_file WHEN label % 4 = 1 THEN '' END AS filter_source,
  CASE WHEN label % 3 = 1 THEN 'text' WHEN label % 3 = 2 THEN '' END AS filter_type,
  CASE label % 5 WHEN 1 THEN 0.0 WHEN 2 THEN 0.2 WHEN 3 THEN 0.6 WHEN 4 THEN 0.7 END
    AS similarity_threshold
FROM (
  SELECT label, source_file, list(x ORDER BY i) AS vector FROM (
    SELECT label, source_file, i, avg(x) AS x FROM (
      SELECT label, source_file, unnest(embedding) AS x,
        generate_subscripts(embedding, 1) AS i FROM cv)
    GROUP BY label, source_file, i) GROUP BY label, source_file)
""", ("cv",))


def knn(queries: str, chunks: str, k: str, where: str = "true", keep: str = "") -> str:
    """Ranked pairs; ``k`` may be a column of the query table."""
    score = "round((1 + list_cosine_similarity(q.vector, c.embedding)) / 2, 6)"
    return f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT q.query_id, {keep} {k} AS k, c.chunk_id, {score} AS score
            FROM {queries} q, {chunks} c WHERE c.embedding IS NOT NULL AND {where}))
    WHERE rank <= k"""


BOTH_FILTERS = (
    "(coalesce(q.filter_source, '') = '' OR q.filter_source = c.source_file) AND "
    "(coalesce(q.filter_type, '') = '' OR q.filter_type = c.content_type)"
)
FLOOR = "score >= 0.3"

cte("hits_plain", knn("q", "cv", "10"), ("q", "cv"))
cte("hits_filtered", knn("q", "cv", "10", BOTH_FILTERS), ("q", "cv"))
cte("hits", f"""
SELECT h.* EXCLUDE (k), q.label AS query_label FROM hits_filtered h JOIN q USING (query_id)
WHERE score >= greatest(0.3, coalesce(similarity_threshold, 0))
""", ("hits_filtered", "q"))
cte("hits_meta", """
SELECT h.query_id, h.score, h.rank, c.* EXCLUDE (embedding) FROM hits h JOIN cv c USING (chunk_id)
""", ("hits", "cv"))
cte("hits_full", """
SELECT h.query_id, h.score, h.rank, c.* EXCLUDE (embedding) REPLACE (coalesce(content, '') AS content)
FROM hits h JOIN cvt c USING (chunk_id)
""", ("hits", "cvt"))
_task_rows = ", ".join(f"('{t}', {i})" for i, t in enumerate(tasks.TASKS))
_recipe_rows = ", ".join(
    f"('{t}', {n}, {'NULL' if text is None else repr(text)}, {k}, '{f}', {b}, {t in tasks.OWN_TOP_K})"
    for t, n, text, k, f, b in tasks.RECIPES
)
cte("recipes", f"SELECT * FROM (VALUES {_recipe_rows}) "
               "t(task, query_no, recipe_text, k, filter, budget, own_k)")
cte("requests", f"""
SELECT task || ':' || source_file AS task_id, task, task_no, source_no,
  CASE WHEN task_no = 3 AND source_no % 2 = 0 THEN '' ELSE 'topic ' || source_no END AS question,
  CASE WHEN task_no <> 2 AND source_no % 4 = 3 THEN '' ELSE source_file END AS source,
  'paper_' || (source_no + 1) AS second_source,
  CASE source_no % 3 WHEN 1 THEN 3 WHEN 2 THEN 25 END AS top_k,
  CASE task_no % 4 WHEN 1 THEN 0.0 WHEN 2 THEN 0.55 WHEN 3 THEN 0.6 END AS similarity_threshold
FROM (SELECT DISTINCT source_file, CAST(substr(source_file, 7) AS INTEGER) AS source_no FROM cv),
  (VALUES {_task_rows}) t(task, task_no)
""", ("cv",))
cte("task_q", """
SELECT r.task_id, r.task, p.query_no, r.task_id || '#' || p.query_no AS query_id,
  coalesce(p.recipe_text, CASE WHEN task = 'literature_survey' AND trim(r.question) = ''
    THEN 'contributions methodology evaluation results' END, r.question) AS query_text,
  CASE WHEN p.filter IN ('optional', 'first') THEN r.source
       WHEN p.filter = 'second' THEN r.second_source END AS filter_source,
  CAST(NULL AS VARCHAR) AS filter_type, r.similarity_threshold, p.budget, l.vector,
  CASE WHEN p.own_k THEN coalesce(nullif(r.top_k, 0), p.k) ELSE p.k END AS top_k
FROM requests r JOIN recipes p USING (task)
JOIN label_q l ON l.label = (r.task_no * 3 + p.query_no + r.source_no) % 10
""", ("requests", "recipes", "label_q"))
cte("task_hits_raw", knn("task_q", "cv", "q.top_k", BOTH_FILTERS,
                         "q.task_id, q.task, q.query_no, q.budget, q.similarity_threshold,"), ("task_q", "cv"))
cte("task_hits", f"""
SELECT * EXCLUDE (seen, k, similarity_threshold),
  row_number() OVER (PARTITION BY task_id ORDER BY query_no, rank) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, chunk_id ORDER BY query_no, rank) AS seen
      FROM task_hits_raw WHERE score >= greatest(0.3, coalesce(similarity_threshold, 0)))
WHERE task = 'comparison' OR seen = 1
""", ("task_hits_raw",))
cte("task_full", """
SELECT h.task_id, h.task, h.query_no, h.budget, h.score, h.rank, h.position,
  c.* EXCLUDE (embedding) REPLACE (coalesce(content, '') AS content)
FROM task_hits h JOIN cvt c USING (chunk_id)
""", ("task_hits", "cvt"))
cte("task_meta", """
SELECT h.task_id, h.task, h.query_no, h.score, h.rank, c.* EXCLUDE (embedding)
FROM task_hits h JOIN cv c USING (chunk_id)
""", ("task_hits", "cv"))
cte("image_meta", """
SELECT image_path, true AS stored, CASE WHEN vec_id % 9 > 0 THEN CAST(vec_id % 100 + 40 AS INTEGER) END AS width,
  CASE WHEN vec_id % 9 > 0 THEN CAST(vec_id * 7 % 100 + 40 AS INTEGER) END AS height
FROM cv WHERE image_path <> '' AND vec_id % 13 > 0
""", ("cv",))

# ------------------------------------------------------------------- documents, lines

cte("raw_lines", """
SELECT doc_id, 'doc_' || doc_id AS source_file, unnest(string_split(text, chr(10))) AS raw,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no,
FROM documents
""")
cte("plain_lines", f"""
SELECT source_file, CAST(line_no // 40 + 1 AS INTEGER) AS page_number, line_no,
  {strip('raw')} AS text, CASE WHEN line_no = 0 THEN 16.0 ELSE 12.0 END AS font_size
FROM raw_lines WHERE {has_text('raw')}
""", ("raw_lines",))
cte("doc_lines", f"""
SELECT * FROM (
  SELECT source_file, CAST(line_no // 40 + 1 AS INTEGER) AS page_number,
    CAST(line_no * 2 + 1 AS INTEGER) AS line_no, {strip('raw')} AS text,
    CASE WHEN line_no = 0 THEN 16.0 ELSE 11.0 END::DOUBLE AS font_size
  FROM raw_lines
  UNION ALL
  SELECT source_file, CAST(line_no // 40 + 1 AS INTEGER), CAST(line_no * 2 AS INTEGER),
    CASE line_no % 12 WHEN 4 THEN '1. Introduction' WHEN 7 THEN 'Results:' ELSE '2.3 Related Work' END,
    11.0::DOUBLE
  FROM raw_lines WHERE line_no % 12 IN (4, 7, 10)) WHERE text <> ''
""", ("raw_lines",))


def sections(lines: str) -> str:
    return f"""
    SELECT source_file, page_number, CAST(min(line_no) AS INTEGER) AS line_no,
      coalesce(max(heading), '') AS section_heading,
      {strip("string_agg(text, chr(10) ORDER BY line_no)")} AS content
    FROM (
      SELECT *, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER (
          PARTITION BY source_file ORDER BY page_number, line_no) AS heading,
        sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (
          PARTITION BY source_file ORDER BY page_number, line_no) AS block
      FROM (SELECT *, {is_heading('text', 'font_size')} AS h FROM {lines}))
    WHERE NOT h GROUP BY source_file, page_number, block
    HAVING {has_text("string_agg(text, chr(10) ORDER BY line_no)")}"""


cte("spans", """
SELECT source_file, page_number, line_no, block_type, s.i - 1 AS span_no, s.w AS text,
  CASE WHEN (s.i - 1) % 4 = 1 THEN NULL ELSE (9 + (s.i - 1) % 6)::DOUBLE END AS size
FROM (
  SELECT source_file, CAST(line_no // 40 + 1 AS INTEGER) AS page_number, line_no,
    CASE WHEN line_no % 9 = 8 THEN 1 ELSE 0 END AS block_type,
    unnest(list_transform(string_split(raw, ' '), lambda w, i: {'w': w, 'i': i})) AS s
  FROM raw_lines)
""", ("raw_lines",))
cte("doc_chunks", f"""
SELECT 'd' || doc_id || '_' || line_no AS chunk_id, 'paper_' || (doc_id // 2) || '.pdf' AS source_file,
  CAST(line_no // 40 + 1 AS INTEGER) AS page_number,
  CASE WHEN line_no % 6 = 0 THEN '' ELSE 'Body' END AS section_heading, line_no AS chunk_index,
  'text' AS content_type, 'paragraph' AS element_type, raw AS content
FROM raw_lines WHERE {has_text('raw')}
""", ("raw_lines",))
cte("raw_tables", """
SELECT 'doc_' || (o_orderkey // 10) AS source_file,
  CAST((o_orderkey // 5) % 2 + 1 AS INTEGER) AS page_number, o_orderkey AS table_idx,
  CASE WHEN cells IS NULL THEN CAST([] AS VARCHAR[][])
       ELSE list_concat([['line', 'part', 'flag']], cells) END AS raw
FROM orders LEFT JOIN (
  SELECT l_orderkey, list([CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
      CASE WHEN l_returnflag <> 'N' THEN l_returnflag END]
      ORDER BY l_linenumber, l_partkey, l_suppkey) AS cells
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
""")
_row = "'| ' || array_to_string(list_transform({}, lambda c: coalesce(c, '')), ' | ') || ' |' || chr(10)"
cte("table_md", f"""
SELECT *, row_number() OVER (PARTITION BY source_file, page_number ORDER BY table_idx) AS no,
  CASE WHEN len(raw) = 0 THEN '' ELSE
    {_row.format('raw[1]')} || {_row.format("list_transform(raw[1], lambda z: '---')")} ||
    array_to_string(list_transform(raw[2:], lambda r: {_row.format('r')}), '') END AS md
FROM raw_tables
""", ("raw_tables",))
cte("figures", """
SELECT *, 'images/' || source_file || '_p' || page_number || '_img' || no || '.' || ext AS image_path
FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file, page_number ORDER BY seq) AS no FROM (
    SELECT 'doc_' || (p_partkey // 8) AS source_file,
      CAST((p_partkey // 4) % 2 + 1 AS INTEGER) AS page_number, p_partkey AS seq,
      ['png', 'jpeg', 'jpg'][p_partkey % 3 + 1] AS ext FROM part))
""")

# -------------------------------------------------------------------------- catalog

cte("catalog", """
SELECT 'd' || doc_id AS id, 'paper_' || (doc_id // 2) || '.pdf' AS filename,
  '/store/d' || doc_id AS file_path, 'pdf' AS file_type,
  CASE WHEN doc_id % 4 <> 3 THEN CAST(ceil(n_chars / 2000.0) AS INTEGER) END AS total_pages,
  CASE WHEN doc_id % 4 <> 3 THEN CAST(ceil(n_chars / 462.0) AS INTEGER) END AS total_chunks,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id // 3 AS INTEGER)) AS ingested_at,
  ['completed', 'completed', 'processing', 'failed'][doc_id % 4 + 1] AS status
FROM documents
""")
cte("status_events", """
SELECT 'd' || user_id AS id,
  CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type IN ('click', 'view') THEN 'processing'
       WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) END AS total_chunks,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value / 10) AS INTEGER) END AS total_pages,
  ts, event_id AS version
FROM events
""")
cte("some_ids", "SELECT 'd' || (doc_id * 3) AS id FROM labels")

# --------------------------------------------------------- traces, replies, judgements

cte("steps", """
SELECT 'run_' || (event_id // 10) AS run_id, CAST(event_id % 10 + 1 AS INTEGER) AS step_number,
  'look at ' || event_type AS thought,
  CASE event_type WHEN 'signup' THEN 'search_text' WHEN 'click' THEN 'Search_Tables'
    WHEN 'view' THEN 'get_paper_preview' WHEN 'error' THEN 'lookup' ELSE 'finish' END AS action,
  props AS action_input_json, repeat(props || ' ', CAST(floor(value) AS INTEGER)) AS observation,
  CAST((event_id // 10) % 3 + 2 AS INTEGER) AS hops,
  event_type = 'purchase' AND value > 20 AS correct
FROM events
""")
cte("ratings", """
SELECT CASE WHEN d.doc_id % 10 > 0 THEN d.lang END AS question_type, r.dimension, r.score FROM (
  SELECT doc_id, unnest([{'dimension': 'quality', 'score': quality * 4 + 1},
                         {'dimension': 'safety', 'score': 5 - toxic * 4}]) AS r FROM labels) l
JOIN documents d USING (doc_id)
""")
cte("versions", """
SELECT o_orderkey AS text_id, pass,
  CAST(floor(CAST(floor(o_totalprice * 100 + o_orderkey * 13) AS BIGINT) % 97 / (pass + 1)) AS DOUBLE) AS score,
  (o_custkey + pass * 37) % 90 / 100 AS burstiness, (o_custkey * 3 + pass * 11) % 80 / 100 AS ttr,
  CAST((o_orderkey + pass) % 5 AS INTEGER) AS human_markers,
  ['varied openings ' || (pass % 2), 'priority ' || o_orderpriority, 'pass ' || pass] AS changes
FROM orders, (VALUES (0), (1), (2), (3)) p(pass)
""")
cte("used_versions", """
SELECT * FROM (
  SELECT *, min(CASE WHEN pass >= 1 AND score <= 20 THEN pass END) OVER (PARTITION BY text_id) AS hit
  FROM versions) WHERE pass <= coalesce(hit, 3)
""", ("versions",))
cte("best", """
SELECT text_id, arg_min(pass, score * 10 + pass) AS best_pass, min(score) AS best_score,
  max(CASE WHEN pass = 0 THEN score END) AS original_score, max(pass) AS passes_used,
  min(score) <= 20 AS target_reached
FROM used_versions GROUP BY text_id
""", ("used_versions",))

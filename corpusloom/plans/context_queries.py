"""Queries that turn hits into contexts, citations, visuals, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import context as ctx
from corpusloom.operators import tools, traces
from corpusloom.plans import answer
from corpusloom.plans import retrieval_queries as rq
from corpusloom.plans import sqltext as sx
from corpusloom.plans.registry import cte, query
from corpusloom.sources import readers, views

_block = (
    "'[Source: ' || source_file || ', Page ' || page_number || CASE WHEN section_heading <> '' "
    "THEN ', Section: ' || section_heading ELSE '' END || '] (Relevance: ' || "
    f"{sx.fixed2('score')} || ')' || chr(10) || content || chr(10)"
)


def packed_sql(source: str, group: str, order: str, budget: str) -> str:
    return f"""
    SELECT {group}, coalesce(string_agg(CASE WHEN used <= {budget} THEN block END,
        chr(10) || '---' || chr(10) ORDER BY {order}), '') AS context,
      count(*) FILTER (used <= {budget}) AS blocks_used, count(*) AS chunks_used
    FROM (SELECT *, sum(length(block)) OVER (PARTITION BY {group} ORDER BY {order}) AS used
          FROM (SELECT *, {_block} AS block FROM {source})) GROUP BY {group}"""


@query("pack_context", packed_sql("hits_full", "query_id", "rank", "4000"), ("hits_full",))
def pack_context(spark, d):
    return ctx.pack_context(rq.full_hits(spark, d), 4000)


def citation_sql(source: str, group: str, order: str) -> str:
    return f"""
    SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS citation_no FROM (
      SELECT *, row_number() OVER (PARTITION BY {group}, source_file, page_number,
          CASE WHEN element_type IN ('figure', 'table', 'equation') THEN element_type ELSE 'text' END,
          regexp_extract(image_path, '([^/]*)$', 1) ORDER BY {order}) AS n
      FROM {source}) WHERE n = 1"""


cte("cited", f"SELECT c.*, m.stored FROM ({citation_sql('hits_meta', 'query_id', 'rank')}) c"
             " LEFT JOIN image_meta m USING (image_path)", ("hits_meta", "image_meta"))
_citation_columns = f"""query_id, citation_no, source_file, page_number, section_heading AS section,
  {sx.round_exact_sql('score', 3)} AS relevance_score, element_type, content_type,
  CASE WHEN stored THEN '/images/' || regexp_extract(image_path, '([^/]*)$', 1) END AS image_url,
  image_description, content_type = 'table' AS has_table, latex_source"""


def _cited(spark, d):
    hits = rq.hits_with(spark, d, views.chunk_vectors(spark, d))
    return ctx.citations(hits, images=views.image_meta(spark, d))


@query("citations", f"SELECT {_citation_columns} FROM cited", ("cited",))
def citations(spark, d):
    return _cited(spark, d).withColumn("has_table", F.col("table_data").isNotNull()).drop("table_data")


@query("visual_citations", f"""
SELECT query_id, citation_no, image_url, latex_source,
  CASE WHEN image_url IS NOT NULL THEN 'image' WHEN has_table THEN 'table' ELSE 'equation' END AS display
FROM (SELECT {_citation_columns} FROM cited)
WHERE image_url IS NOT NULL OR has_table OR latex_source IS NOT NULL
""", ("cited",))
def visual_citations(spark, d):
    return ctx.visual_citations(_cited(spark, d)).select(
        "query_id", "citation_no", "image_url", "latex_source", "display"
    )


cte("visuals", """
SELECT chunk_id, source_file, element_type, page_number, section_heading, left(coalesce(content, ''), 500) AS content,
  CASE WHEN width IS NOT NULL THEN '/images/' || regexp_extract(image_path, '([^/]*)$', 1) END AS image_url,
  width AS image_width, height AS image_height,
  CASE element_type WHEN 'figure' THEN 0 WHEN 'table' THEN 1 ELSE 2 END AS type_order,
  image_description, element_type = 'table' AS has_table, latex_source
FROM cvt LEFT JOIN image_meta m USING (image_path)
WHERE element_type IN ('figure', 'table', 'equation')
  AND CASE WHEN m.stored THEN coalesce(width, 0) >= 50 AND coalesce(height, 0) >= 50
      ELSE element_type <> 'figure' END
""", ("cvt", "image_meta"))


def _visuals(spark, d):
    return ctx.list_visuals(views.chunks_with_text(spark, d), views.image_meta(spark, d))


@query("list_visuals", """
SELECT * FROM visuals ORDER BY source_file, page_number, type_order, chunk_id
""", ("visuals",))
def list_visuals(spark, d):
    return _visuals(spark, d).withColumn("has_table", F.col("table_data").isNotNull()).drop("table_data")


@query("visual_counts", """
SELECT source_file, count(*) FILTER (element_type = 'figure') AS n_figures,
  count(*) FILTER (element_type = 'table') AS n_tables,
  count(*) FILTER (element_type = 'equation') AS n_equations, count(*) AS n_total
FROM visuals GROUP BY source_file
""", ("visuals",))
def visual_counts(spark, d):
    return ctx.visual_counts(_visuals(spark, d))


cte("near", """
SELECT source_file, page_number, string_agg(content, chr(10) || chr(10) ORDER BY n) AS context FROM (
  SELECT p.source_file, t.page_number, left(p.content, 600) AS content,
    row_number() OVER (PARTITION BY p.source_file, t.page_number ORDER BY p.chunk_index, p.chunk_id) AS n
  FROM cvt p JOIN (SELECT DISTINCT source_file, page_number FROM cv) t
    ON p.source_file = t.source_file AND abs(p.page_number - t.page_number) <= 1
  WHERE p.element_type = 'paragraph' AND p.content IS NOT NULL) WHERE n <= 5 GROUP BY source_file, page_number
""", ("cvt", "cv"))


def _neighbours(spark, d):
    chunks = views.chunks_with_text(spark, d)
    visual = views.chunk_vectors(spark, d).where(F.col("element_type") != "paragraph").select(
        "chunk_id", "source_file", "page_number", "element_type", "image_description"
    )
    return ctx.neighbor_context(visual, chunks)


@query("neighbor_context", """
SELECT c.chunk_id, c.source_file, c.page_number,
  coalesce(n.context, '(no surrounding text available)') AS context
FROM cv c LEFT JOIN near n USING (source_file, page_number) WHERE c.element_type <> 'paragraph'
""", ("cv", "near"))
def neighbor_context(spark, d):
    return _neighbours(spark, d).select("chunk_id", "source_file", "page_number", "context")


_visual_case = "CASE element_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ctx.VISUAL_TEMPLATES.items()) + " END"


@query("visual_prompt", f"""
SELECT c.chunk_id, {_visual_case} || chr(10) || chr(10) || 'Text near page ' || page_number || ':' || chr(10)
  || coalesce(n.context, '(no surrounding text available)') || chr(10)
  || CASE WHEN image_description IS NOT NULL THEN
       chr(10) || 'Stored description:' || chr(10) || image_description || chr(10) ELSE '' END
  || CASE WHEN page_number % 2 = 0 THEN
       chr(10) || 'Reader''s question:' || chr(10) || 'what about ' || chunk_id || chr(10) ELSE '' END AS prompt
FROM cv c LEFT JOIN near n USING (source_file, page_number) WHERE c.element_type <> 'paragraph'
""", ("cv", "near"))
def visual_prompt(spark, d):
    asked = _neighbours(spark, d).withColumn(
        "question",
        F.when(F.col("page_number") % 2 == 0, F.concat(F.lit("what about "), "chunk_id")).otherwise(" "),
    )
    return ctx.assemble_visual_prompt(asked).select("chunk_id", "prompt")


# --------------------------------------------------------------------- task contexts

cte("task_budgets", "SELECT *, task_id || '/' || CASE WHEN task = 'comparison' THEN query_no ELSE 0 END"
    " AS part FROM task_full", ("task_full",))
cte("task_packed", """
SELECT task_id, string_agg(context, chr(10) || '======' || chr(10) ORDER BY part) AS context,
  max(CASE WHEN part LIKE '%/0' THEN context END) AS first,
  max(CASE WHEN part LIKE '%/1' THEN context END) AS second,
  CAST(sum(chunks_used) AS BIGINT) AS chunks_used
FROM (""" + packed_sql("task_budgets", "task_id, part, budget", "position", "budget") + """
) GROUP BY task_id
""", ("task_budgets",))


def _label_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ctx.QUERY_LABELS.items())
    topic = f"CASE WHEN task = 'literature_survey' AND question = '' THEN '{ctx.ALL_PAPERS}' ELSE question END"
    name = f"CASE WHEN task = 'summarization' AND source = '' THEN '{ctx.ALL_DOCUMENTS}' ELSE source END"
    return (f"replace(replace(replace(CASE task {cases} END, '{{question}}', {topic}),"
            f" '{{second_source}}', second_source), '{{source}}', {name})")


def _default_sql() -> str:
    cases = " ".join(
        "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''"))
        for k, v in ctx.DEFAULT_ANSWERS.items()
    )
    return f"replace(CASE task {cases} END, '{{question}}', question)"


@query("answer_shell", f"""
, cites AS (SELECT task_id, count(*) AS n FROM ({citation_sql('task_full', 'task_id', 'position')})
            GROUP BY task_id),
asked AS (
  SELECT task_id, task, question, source, second_source, task_id AS found_id FROM requests
  UNION ALL SELECT 'none_' || task_id, task, question, source, second_source, NULL FROM requests)
SELECT a.task_id, a.task, a.question, a.source, a.second_source, {_label_sql()} AS query, coalesce(p.context, '') AS context,
  coalesce(p.chunks_used, 0) AS chunks_used, coalesce(c.n, 0) AS n_citations,
  CASE WHEN p.task_id IS NULL THEN {_default_sql()} END AS default_answer
FROM asked a LEFT JOIN task_packed p ON p.task_id = a.found_id LEFT JOIN cites c ON c.task_id = a.found_id
""", ("requests", "task_full", "task_packed"))
def answer_shell(spark, d):
    hits = rq.full_task_hits(spark, d)
    requests = views.task_requests(spark, d).select(
        "task_id", "task", "question", "source", "second_source")
    unmatched = requests.withColumn("task_id", F.concat(F.lit("none_"), "task_id"))
    return ctx.answer_shell(
        requests.unionByName(unmatched), answer.contexts(hits).drop("first", "second"),
        answer.cited(hits),
    ).drop("citations")


def _template_sql() -> str:
    cases = " ".join(
        "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''").replace("\n", "' || chr(10) || '"))
        for k, v in ctx.TASK_TEMPLATES.items()
    )
    topic = f"CASE WHEN task = 'literature_survey' AND question = '' THEN '{ctx.WITHOUT_TOPIC}' ELSE question END"
    sql = f"replace(CASE task {cases} END, '{{question}}', {topic})"
    for name in ("source", "second_source", "first", "second", "context"):
        sql = f"replace({sql}, '{{{name}}}', coalesce({name}, ''))"
    return sql


@query("assemble_prompt", f"""
SELECT task_id, {_template_sql()} AS prompt FROM requests JOIN task_packed USING (task_id)
""", ("requests", "task_packed"))
def assemble_prompt(spark, d):
    packed = answer.contexts(rq.full_task_hits(spark, d))
    return ctx.assemble_prompt(views.task_requests(spark, d).join(packed, "task_id")).select(
        "task_id", "prompt"
    )


@query("format_observation", f"""
SELECT a.query_id, coalesce(t, 'No relevant text content found for query: ''' || a.query_id || '''.')
  AS observation
FROM (SELECT query_id FROM q UNION ALL SELECT 'none_' || query_id FROM q) a LEFT JOIN (
  SELECT query_id, string_agg('[' || source_file || ', p.' || page_number
    || CASE WHEN section_heading <> '' THEN ', §' || section_heading ELSE '' END || '] (score='
    || {sx.fixed2('score')} || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS t
  FROM hits_full GROUP BY query_id) h USING (query_id)
""", ("q", "hits_full"))
def format_observation(spark, d):
    asked = views.questions(spark, d).select("query_id")
    requests = asked.union(asked.select(F.concat(F.lit("none_"), "query_id")))
    return ctx.format_observation(
        rq.full_hits(spark, d),
        requests.withColumn("content_type", F.lit("text")).withColumn("question", F.col("query_id")),
    )


@query("table_preview", f"""
SELECT table_idx, CASE
    WHEN table_idx % 7 = 0 THEN 'a | ' || table_idx
    WHEN len(lines) > 0 THEN left(array_to_string(lines, chr(10)), 120)
    WHEN table_idx % 2 = 0 THEN 'Table · ' || len(raw) || ' rows × ? cols' ELSE 'Table' END AS preview
FROM (SELECT *, list_filter(list_transform(raw[1:3], lambda r: array_to_string(list_filter(
        list_transform(r, lambda c: {sx.strip("coalesce(c, '')")}), lambda c: c <> ''), ' | ')),
        lambda l: l <> '') AS lines FROM raw_tables)
""", ("raw_tables",))
def table_preview(spark, d):
    idx = F.col("table_idx")
    names = F.when(idx % 7 == 0, F.array(F.lit("a"), idx.cast("string")))
    rows = F.when(idx % 2 == 0, F.size("raw"))
    return views.raw_tables(spark, d).select(
        "table_idx",
        ctx.table_preview(names, F.col("raw"), rows, F.lit(None).cast("int")).alias("preview"),
    )


# ---------------------------------------------------------------- traces, conversations


@query("parse_react", """
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'no action ' || role ELSE 'think ' || role END AS thought,
  CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 5 = 1 THEN 'finish' ELSE 'search_text' END AS action,
  CASE turn % 5 WHEN 0 THEN 'query=c' || conv_id || ';source_file=f' WHEN 1 THEN 'answer=done ' || turn
    WHEN 2 THEN 'raw_input={broken ' || conv_id || '}' WHEN 3 THEN 'answer=c' || conv_id ELSE '' END AS arguments
FROM conversations
""")
def parse_react(spark, d):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kind = F.col("turn") % 5
    think = F.concat(F.lit("think "), "role", F.lit(" \n"))
    raw = (
        F.when(kind == 0, F.concat(think, F.lit("Action: search_text\nAction Input: {\"query\": \"c"), conv,
                                   F.lit('", "source_file": "f"} tail')))
        .when(kind == 1, F.concat(think, F.lit('ACTION:  finish\naction input: {"answer": "done '), turn,
                                  F.lit('"}')))
        .when(kind == 2, F.concat(think, F.lit("Action: search_text\nAction Input: {broken "), conv, F.lit("}")))
        .when(kind == 3, F.concat(think, F.lit('Action: search_text\nAction Input: {"answer": "c'), conv,
                                  F.lit('" , bad}')))
        .otherwise(F.concat(F.lit(" no action "), "role", F.lit(" \n")))
    )
    replies = readers.read_table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return traces.parse_react(replies).select(
        "conv_id", "turn", "thought", "action",
        F.array_join(
            F.transform(
                F.map_entries("action_input"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
            ),
            ";",
        ).alias("arguments"),
    )


@query("history_window", """
SELECT conv_id, chr(10) || 'Previous conversation:' || chr(10) || string_agg(
    upper(role) || ': ' || left(text, 200), chr(10) ORDER BY turn) || chr(10) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
WHERE n <= 4 GROUP BY conv_id
""")
def history_window(spark, d):
    return traces.history_window(readers.read_table(spark, d, "conversations"))


@query("trace_digest", """
SELECT run_id, string_agg('Step ' || step_number || ': ' || thought || chr(10) || 'Action: ' || action || '('
    || action_input_json || ')' || chr(10) || 'Observation: ' || left(left(observation, 2000), 500) || '...'
    || chr(10) || chr(10), '' ORDER BY step_number) AS trace, count(*) AS n_steps
FROM steps GROUP BY run_id
""", ("steps",))
def trace_digest(spark, d):
    return traces.trace_digest(views.agent_steps(spark, d))


cte("tool_requests", """
SELECT item_id AS request_id, item_id % 10 AS label, item_id % 9 AS kind,
  CASE WHEN item_id % 2 = 0 THEN '' WHEN item_id % 5 = 3 THEN 'absent' ELSE 'paper_' || (item_id % 4) END
    AS filter_source
FROM benchmark
""")
cte("tool_q", """
SELECT request_id AS query_id, filter_source, l.vector, 'query ' || label AS question,
  ['text', 'table', 'figure', 'equation'][kind + 1] AS filter_type
FROM tool_requests JOIN label_q l USING (label) WHERE kind < 4
""", ("tool_requests", "label_q"))
cte("tool_typed", f"SELECT * FROM ({sx.knn('tool_q', 'cv', '5', sx.BOTH_FILTERS)}) WHERE {sx.FLOOR}",
    ("tool_q", "cv"))
_untyped = ("(SELECT * REPLACE ('' AS filter_type) FROM tool_q"
            " WHERE query_id NOT IN (SELECT query_id FROM tool_typed))")
cte("tool_hits", f"""
SELECT * FROM tool_typed UNION ALL
SELECT * FROM ({sx.knn(_untyped, 'cv', '5', sx.BOTH_FILTERS)}) WHERE {sx.FLOOR}
""", ("tool_typed", "tool_q", "cv"))


@query("run_tools", f"""
, seen AS (SELECT query_id, string_agg('[' || source_file || ', p.' || page_number
    || CASE WHEN section_heading <> '' THEN ', §' || section_heading ELSE '' END || '] (score='
    || {sx.fixed2('score')} || ')' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY rank) AS t
  FROM tool_hits JOIN cvt USING (chunk_id) GROUP BY query_id),
heads AS (SELECT source_file, string_agg('--- [Chunk ' || chunk_index || '] ---' || chr(10)
    || coalesce(content, '') || chr(10) || chr(10), '' ORDER BY chunk_index) AS body
  FROM cvt WHERE chunk_index IN (0, 1, 2) GROUP BY source_file)
SELECT CAST(r.request_id AS VARCHAR) AS request_id, CASE
  WHEN kind < 4 THEN coalesce(t, 'No relevant ' || filter_type || ' content found for query: ''' || question || '''.')
  WHEN kind = 4 THEN CASE WHEN body IS NULL
    THEN 'No preview available for paper ''' || 'paper_' || label || '''.'
    ELSE 'Preview of top sections in ''' || 'paper_' || label || ''':' || chr(10) || chr(10) || body END
  WHEN kind = 5 THEN 'Available research papers:' || chr(10) || (SELECT string_agg('- ' || filename || '  ('
    || total_pages || ' pages, ' || total_chunks || ' chunks)', chr(10) ORDER BY ingested_at DESC, id)
    FROM catalog WHERE status = 'completed')
  WHEN kind = 6 THEN 'Unknown tool ''lookup''. Available tools: [''search_text'', ''search_tables'', '
    || '''search_figures'', ''search_equations'', ''get_paper_preview'', ''get_paper_list'']'
  ELSE 'Invalid arguments for tool ''search_text'': '
    || CASE WHEN r.request_id % 2 = 0 THEN 'missing query' ELSE 'unexpected depth' END END AS observation
FROM tool_requests r LEFT JOIN tool_q q ON q.query_id = r.request_id
LEFT JOIN seen s ON s.query_id = r.request_id
LEFT JOIN heads h ON h.source_file = 'paper_' || r.label WHERE kind < 8
""", ("tool_requests", "tool_q", "tool_hits", "cvt", "catalog"))
def run_tools(spark, d):
    """Benchmark items as tool requests: every tool, an unknown one, wrong arguments."""
    item, label = F.col("item_id"), (F.col("item_id") % 10).cast("string")
    kind = item % 9
    source = (
        F.when(item % 2 == 0, "").when(item % 5 == 3, "absent")
        .otherwise(F.concat(F.lit("paper_"), (item % 4).cast("string")))
    )
    text = F.concat(F.lit("query "), label)
    args = (
        F.when(kind < 4, F.create_map(F.lit("query"), text, F.lit("source_file"), source))
        .when(kind == 4, F.create_map(F.lit("source_file"), F.concat(F.lit(" paper_"), label)))
        .when((kind == 7) & (item % 2 == 1), F.create_map(F.lit("query"), text, F.lit("depth"), F.lit("2")))
        .when(kind == 7, F.create_map(F.lit("source_file"), source))
        .when(kind == 6, F.create_map(F.lit("query"), text))
    )
    action = views.pick(kind, "search_text", "Search_Tables", "search_figures", "search_equations",
                        "get_paper_preview", "get_paper_list", "lookup", "search_text", "finish")
    requests = readers.read_table(spark, d, "benchmark").select(
        item.alias("request_id"), action.alias("action"), args.alias("action_input"))
    labels = views.label_questions(spark, d).select(
        F.concat(F.lit("query "), "label").alias("query_text"), "vector")
    return tools.run_tools(
        requests, lambda q: q.join(labels, "query_text"), views.chunk_vectors(spark, d),
        views.chunks_with_text(spark, d), views.catalog(spark, d))


@query("validate_actions", """
SELECT run_id, step_number, action, 'Unknown tool ''' || action || '''. Available tools: [''search_text'', '
  || '''search_tables'', ''search_figures'', ''search_equations'', ''get_paper_preview'', ''get_paper_list'']'
  AS observation
FROM steps WHERE lower(action) NOT IN ('search_text', 'search_tables', 'search_figures', 'search_equations',
  'get_paper_preview', 'get_paper_list', 'finish')
""", ("steps",))
def validate_actions(spark, d):
    return traces.validate_actions(views.agent_steps(spark, d)).select(
        "run_id", "step_number", "action", "observation"
    )


@query("agent_run_stats", """
SELECT hops, count(*) AS n_runs, avg(finished::INT) AS completion_rate, avg(n_steps) AS mean_steps,
  avg(n_calls) AS mean_tool_calls, avg((n_steps >= 10)::INT) AS share_at_cap, avg(correct::INT) AS accuracy
FROM (SELECT run_id, max(hops) AS hops, bool_or(action = 'finish') AS finished, count(*) AS n_steps,
        count(*) FILTER (lower(action) IN ('search_text', 'search_tables', 'get_paper_preview')) AS n_calls,
        bool_or(correct) AS correct FROM steps GROUP BY run_id) GROUP BY hops
""", ("steps",))
def agent_run_stats(spark, d):
    return traces.agent_run_stats(views.agent_steps(spark, d))


@query("tool_mix", "SELECT lower(action) AS action, count(*) AS n_calls FROM steps GROUP BY lower(action)",
       ("steps",))
def tool_mix(spark, d):
    return traces.tool_mix(views.agent_steps(spark, d))

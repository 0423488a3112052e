"""Roles the driver tables play, as DataFrames and as the same SQL.

documents -> refined notices (one line is one paragraph) and tagged rule files,
embeddings -> vectors, benchmark -> questions, labels -> gold and predicted
routes, pages -> stored board pages, conversations -> question/answer pairs,
events -> hits, metrics and run logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import WHITE_SPACE, strip
from ..functions.text import tokens
from ..session import spread
from .registry import Tables

LINES = r"\n+"  # the driver documents hold single newlines only


# --- SQL spellings of shared expressions ---

def sql_strip(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{WHITE_SPACE}]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}0-9]+'), lambda tk: tk <> '')"


def sql_blocks(x: str, separator: str = r"\n+") -> str:
    return (f"list_filter(list_transform(string_split_regex({sql_strip(x)}, '{separator}'), "
            f"lambda p: {sql_strip('p')}), lambda p: p <> '')")


# --- notices ---

def notices(t: Tables) -> DataFrame:
    return spread(t.documents, "doc_id").select(
        "doc_id", F.col("doc_id").cast("string").alias("notice_id"),
        F.split("text", "\n")[0].alias("title"),
        F.struct(F.lit(None).cast("string").alias("year"), F.col("lang").alias("category"),
                 F.lit(None).cast("string").alias("target"), F.col("source").alias("entity")).alias("metadata"),
        F.col("text").alias("refined_content"))


SQL_NOTICES = """notices AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS notice_id, string_split(text, chr(10))[1] AS title,
         lang AS category, source AS entity, text FROM documents)"""

SQL_CHUNKS = SQL_NOTICES + f""",
blocks AS (SELECT *, {sql_blocks('text')} AS b FROM notices),
folded AS (
  SELECT *, list_reduce(
    list_transform(b, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x}}),
    lambda a, x: CASE WHEN length(a.cur) + length(x.cur) < 50
      THEN {{'done': a.done, 'cur': a.cur || chr(10) || x.cur}}
      ELSE {{'done': list_append(a.done, a.cur), 'cur': x.cur}} END) AS r
  FROM blocks WHERE len(b) > 0),
listed AS (SELECT *, list_append(r.done, r.cur) AS cs FROM folded),
chunks AS (
  SELECT doc_id, notice_id AS parent_id, title, category, entity,
         unnest(range(1, len(cs) + 1)) AS chunk_no, unnest(cs) AS chunk FROM listed),
notice_chunks AS (
  SELECT notice_id_of.*, parent_id || '_chunk_' || chunk_no AS chunk_id,
         '문서정보: [' || category || ' - ' || entity || '] ' || title || chr(10) || chr(10)
         || '내용:' || chr(10) || chunk AS chunk_text
  FROM chunks notice_id_of)"""


# --- rule files: every document line is a page, every sentence a paragraph ---

def rule_files(t: Tables) -> DataFrame:
    number = lambda i: F.when(i == 3, F.lit("iv")).otherwise((i + 1).cast("string"))
    page = lambda line, i: F.concat(
        F.replace(line, F.lit(". "), F.lit(".\n\n")),
        F.lit('\n\n<page doc_id="1-'), F.col("doc_id").cast("string"),
        F.lit('" num="'), number(i), F.lit('"></page>\n\n'))
    body = F.array_join(F.transform(F.split("text", "\n"), page), "")
    return spread(t.documents, "doc_id").select(F.concat(F.lit("rule_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
                              F.concat(body, F.lit("untagged tail")).alias("text"))


SQL_PAGES = f"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_index FROM documents),
rule_pages AS (
  SELECT 'rule_' || doc_id || '.md' AS source, page_index, '1-' || doc_id AS doc_id,
         CASE WHEN page_index = 4 THEN 'iv' ELSE CAST(page_index AS VARCHAR) END AS page_num_raw,
         {sql_strip("replace(line, '. ', '.' || chr(10) || chr(10))")} AS page_text
  FROM lines WHERE {sql_strip('line')} <> '')"""

SQL_RULE_CHUNKS = SQL_PAGES + f""",
rule_folded AS (
  SELECT *, list_reduce(
    list_transform({sql_blocks('page_text', chr(92) + 'n' + chr(92) + 'n')},
      lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x || chr(10) || chr(10)}}),
    lambda a, x: CASE WHEN length(a.cur) > 0 AND length(a.cur) + length(x.cur) - 2 > 800
      THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur}}
      ELSE {{'done': a.done, 'cur': a.cur || x.cur}} END) AS r
  FROM rule_pages),
rule_listed AS (SELECT *, list_append(r.done, r.cur) AS cs FROM rule_folded),
rule_chunks AS (
  SELECT source, page_index, doc_id, page_num_raw, TRY_CAST(page_num_raw AS INTEGER) AS page_num,
         unnest(range(1, len(cs) + 1)) AS chunk_no, {sql_strip('unnest(cs)')} AS text FROM rule_listed)"""


# --- questions and answers ---

def qa(t: Tables) -> DataFrame:
    """User turns with the assistant turn after them; the truth is the document numbered
    like the conversation, the contexts are the lines of the next document."""
    said = spread(t.conversations, "conv_id")
    asked = said.filter(F.col("role") == "user").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("__next"), F.col("text").alias("question"))
    replied = said.filter(F.col("role") == "assistant").select(
        F.col("conv_id"), F.col("turn").alias("__next"), F.col("text").alias("answer"))
    truth = t.documents.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("ground_truth"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: strip(x)), lambda x: x != "")
    contexts = t.documents.select((F.col("doc_id") - 1).alias("conv_id"), lines.alias("contexts"))
    return (asked.join(replied, ["conv_id", "__next"]).join(truth, "conv_id").join(contexts, "conv_id")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", "turn",
                    "question", "answer", "ground_truth", "contexts"))


SQL_QA = f"""qa AS (
  SELECT u.conv_id * 1000 + u.turn AS qa_id, u.conv_id, u.turn, u.text AS question, a.text AS answer,
         d.text AS ground_truth,
         list_filter(list_transform(string_split(c.text, chr(10)), lambda x: {sql_strip('x')}),
                     lambda x: x <> '') AS contexts
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN documents d ON d.doc_id = u.conv_id
  JOIN documents c ON c.doc_id = u.conv_id + 1
  WHERE u.role = 'user')"""


# --- routes ---

def routes(t: Tables) -> DataFrame:
    return t.labels.select(
        "doc_id", F.when(F.col("quality") == 1, "TEXT").otherwise("VISION").alias("gold"),
        F.when(F.col("toxic") == 1, "VISION").otherwise("TEXT").alias("pred"))


SQL_ROUTES = """routes AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'TEXT' ELSE 'VISION' END AS gold,
         CASE WHEN toxic = 1 THEN 'VISION' ELSE 'TEXT' END AS pred FROM labels)"""


def labelled_questions(t: Tables) -> DataFrame:
    """The text of every labelled document as the question of its gold route."""
    return routes(t).join(t.documents.select("doc_id", F.col("text").alias("question")), "doc_id")


SQL_LABELLED = SQL_ROUTES + """,
labelled AS (
  SELECT r.*, d.text AS question FROM routes r JOIN documents d USING (doc_id))"""


# --- hits: users ask, events answer ---

def answer_key(c: str = "props") -> Column:
    return F.from_json(F.col(c), "struct<k:bigint>")["k"]


def hits(t: Tables) -> DataFrame:
    """Every event is a hit of its user: document from the JSON value, page from the id."""
    return t.events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"),
        answer_key().alias("doc_id"), F.pmod("event_id", F.lit(5)).cast("int").alias("page_num"),
        F.concat(F.lit("["), F.col("event_type"), F.lit("] "), answer_key().cast("string")).alias("source"))


SQL_HITS = """hits AS (
  SELECT user_id AS query_id, event_id AS chunk_id, value AS score,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id,
         CAST(event_id % 5 AS INTEGER) AS page_num,
         '[' || event_type || '] ' || json_extract_string(props, '$.k') AS source FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits)"""


def media(t: Tables) -> DataFrame:
    """Documents as files in folders: folder from the length, kind from the id."""
    kind = F.element_at(F.array(F.lit(".pdf"), F.lit(".png"), F.lit(".PDF"), F.lit(".hwp")),
                        (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return t.documents.select(
        F.pmod("n_chars", F.lit(100)).alias("doc_id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), kind).alias("path"))


SQL_MEDIA = """media AS (
  SELECT n_chars % 100 AS doc_id,
         source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png'
           WHEN 2 THEN '.PDF' ELSE '.hwp' END AS path FROM documents)"""


# --- metric reports: event values, every 17th missing as NaN ---

def scored_runs(t: Tables) -> DataFrame:
    gap = F.when(F.pmod("event_id", F.lit(17)) == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select("event_id", F.col("event_type").alias("pipeline"), gap.alias("faithfulness"),
                           F.col("value").alias("latency"),
                           (F.col("value") / 500).alias("answer_correctness"), answer_key().alias("k"))


SQL_RUNS = """runs AS (
  SELECT event_id, event_type AS pipeline,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS faithfulness, value AS latency,
         value / 500 AS answer_correctness, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


# --- vectors ---

def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
                               F.col("label").cast("bigint").alias("cell"))


def question_vectors(t: Tables) -> DataFrame:
    """Questions whose id has a vector."""
    return t.benchmark.select(F.col("item_id").alias("query_id")).join(
        t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


SQL_VECTORS = """vecs AS (
  SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, label AS cell FROM embeddings),
asked AS (SELECT b.item_id AS query_id, v.v FROM benchmark b JOIN vecs v ON v.chunk_id = b.item_id)"""


def token_list(c: str) -> Column:
    return tokens(c)

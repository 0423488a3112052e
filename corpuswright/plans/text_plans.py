"""Projections and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import contexts as C, core, routes as R, text as X
from ..operators import chunking, filters
from ..session import spread
from . import roles
from .registry import Tables, query
from .roles import sql_norm, sql_strip


@query("context_header", f"""WITH {roles.SQL_NOTICES}
SELECT doc_id, '[' || category || ' - ' || entity || '] ' || title AS header FROM notices""")
def context_header(t: Tables) -> DataFrame:
    n = roles.notices(t)
    return n.select("doc_id", X.context_header(
        F.col("metadata.category"), F.col("metadata.entity"), F.col("title")).alias("header"))


@query("context_header_defaults", """SELECT conv_id, turn,
  '[' || CASE WHEN role = 'system' THEN '분류없음' ELSE role END || ' - '
  || CASE WHEN turn = 0 THEN '부서없음' ELSE CAST(turn AS VARCHAR) END || '] '
  || CASE WHEN role = 'user' THEN '제목 없음' ELSE text END AS header FROM conversations""")
def context_header_defaults(t: Tables) -> DataFrame:
    c = t.conversations
    return c.select("conv_id", "turn", X.context_header(
        F.nullif("role", F.lit("system")), F.nullif(F.col("turn"), F.lit(0)).cast("string"),
        F.when(F.col("role") != "user", F.col("text"))).alias("header"))


@query("contextual_chunk_text", f"""WITH {roles.SQL_CHUNKS}
SELECT chunk_id, chunk_text FROM notice_chunks""")
def contextual_chunk_text(t: Tables) -> DataFrame:
    return chunking.notice_chunks(roles.notices(t), separator=roles.LINES).select("chunk_id", "chunk_text")


@query("flatten_metadata", f"""WITH {roles.SQL_NOTICES}
SELECT doc_id, '' AS year, category, '' AS target, entity FROM notices""")
def flatten_metadata(t: Tables) -> DataFrame:
    return roles.notices(t).select("doc_id", *[
        X.metadata_field("metadata", n).alias(n) for n in ("year", "category", "target", "entity")])


@query("unify_hit_schema", """SELECT doc_id AS chunk_no,
  '[공지사항-' || CASE WHEN lang = 'en' THEN '' WHEN lang = 'de' THEN '일반' ELSE lang END || '] ' || source AS merged_source,
  '[공지-' || CASE WHEN lang IN ('en', 'de') THEN '일반' ELSE lang END || '] ' || source AS node_source,
  1 AS page_num, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents""")
def unify_hit_schema(t: Tables) -> DataFrame:
    category = F.when(F.col("lang") == "en", "").when(F.col("lang") != "de", F.col("lang"))
    return t.documents.select(
        F.col("doc_id").alias("chunk_no"),
        C.source_label(category, F.col("source"), fixed.MERGED_SOURCE_LAYOUT, empty_is_missing=False).alias("merged_source"),
        C.source_label(category, F.col("source"), fixed.NODE_SOURCE_LAYOUT, empty_is_missing=True).alias("node_source"),
        F.lit(1).alias("page_num"), F.col("doc_id").cast("string").alias("doc_id"), "text")


@query("integrate_sections", """SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN lang <> 'de' THEN
  '### TITLE: ' || source || chr(10) || chr(10) || '### DATE: ' || chr(10) || chr(10)
  || '### URL: ' || lang || chr(10) || chr(10) || '### CONTENT:' || chr(10) || text END,
  CASE WHEN lang = 'en' THEN '### IMAGE_OCR:' || chr(10) || source END,
  CASE WHEN n_chars > 500 THEN '### ATTACHMENT_TEXT:' || chr(10) || '<' || source || '>' || chr(10) || text || chr(10) || '<' || lang || '>' || chr(10) || lang END) AS integrated
FROM documents""")
def integrate_sections(t: Tables) -> DataFrame:
    c = F.col
    files = F.when(c("n_chars") > 500, F.array(F.struct(c("source").alias("name"), c("text")),
                                               F.struct(c("lang").alias("name"), c("lang").alias("text"))))
    return t.documents.select("doc_id", X.integrate_sections(
        c("source"), F.lit(None).cast("string"), c("lang"), c("text"),
        F.when(c("lang") == "en", c("source")), X.attachment_text(files), c("lang") != "de").alias("integrated"))


@query("page_tag", r"""WITH p AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN text || ' 1-' || doc_id || '~' || n_chars
                      WHEN lang = 'fr' THEN '2-3-' || doc_id || '∼7 ' || text ELSE text END AS body,
         CASE WHEN lang = 'de' THEN '4-' || doc_id || ' ' || source ELSE source END AS file_name FROM documents)
SELECT doc_id AS row_id,
  coalesce(nullif(regexp_extract(body, '(\d+(?:-\d+)+)[~∼](\d+)', 1), ''),
           nullif(regexp_extract(file_name, '(\d+(?:-\d+)+)', 1), ''), 'unknown') AS tag_doc_id,
  coalesce(nullif(regexp_extract(body, '(\d+(?:-\d+)+)[~∼](\d+)', 2), ''), CAST(doc_id + 1 AS VARCHAR)) AS tag_page
FROM p""")
def page_tag(t: Tables) -> DataFrame:
    c, lit = F.col, F.lit
    d = c("doc_id").cast("string")
    body = (F.when(c("lang") == "en", F.concat(c("text"), lit(" 1-"), d, lit("~"), c("n_chars").cast("string")))
            .when(c("lang") == "fr", F.concat(lit("2-3-"), d, lit("∼7 "), c("text"))).otherwise(c("text")))
    name = F.when(c("lang") == "de", F.concat(lit("4-"), d, lit(" "), c("source"))).otherwise(c("source"))
    tag = X.page_tag(body, name, c("doc_id") + 1)
    return t.documents.select(c("doc_id").alias("row_id"), tag["doc_id"].alias("tag_doc_id"),
                              tag["num"].alias("tag_page"))


@query("norm_ws", f"SELECT doc_id, {sql_norm('text')} AS normalised FROM documents")
def norm_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", core.norm_ws("text").alias("normalised"))


@query("safe_filename", r"""SELECT page_id, regexp_replace(trim(string_split(url, chr(10))[1]), '[\\/:*?"<>|]', '_', 'g') AS file_name
FROM pages""")
def safe_filename(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.safe_filename("url").alias("file_name"))


@query("complete_date", """WITH e AS (SELECT event_id, ts, event_type, strftime(ts, '%m-%d') AS short, strftime(ts, '%Y-%m-%d') AS long FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN make_date(2023, CAST(month(ts) AS INTEGER), CAST(day(ts) AS INTEGER))
  WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS posted FROM e""")
def complete_date(t: Tables) -> DataFrame:
    shown = (F.when(F.col("event_type") == "view", F.date_format("ts", "MM-dd"))
             .when(F.col("event_type") == "error", F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return t.events.select("event_id", X.complete_date(shown, 2023).alias("posted"))


@query("truncate_text", """SELECT doc_id, substring(text, 1, 150) AS t150, length(substring(text, 1, 1500)) AS n1500,
  length(substring(text, 1, 4000)) AS n4000, length(substring(text, 1, 15000)) AS n15000 FROM documents""")
def truncate_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate_text("text", 150).alias("t150"), *[
        F.length(X.truncate_text("text", n)).cast("bigint").alias(f"n{n}") for n in (1500, 4000, 15000)])


@query("source_to_notice_id", r"""WITH s AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'rules/' || event_type || '_' || user_id || '.md'
    WHEN event_type = 'click' THEN 'plain ' || user_id ELSE '[' || event_type || '] ' || user_id END AS source FROM events)
SELECT event_id, nullif(regexp_extract(source, '\]\s*(\d+)', 1), '') AS notice_id,
  CASE WHEN ends_with(source, '.md') THEN replace(string_split(source, '/')[-1], '.md', '.pdf') END AS pdf_name FROM s""")
def source_to_notice_id(t: Tables) -> DataFrame:
    u, e = F.col("user_id").cast("string"), F.col("event_type")
    source = (F.when(e == "view", F.concat(F.lit("rules/"), e, F.lit("_"), u, F.lit(".md")))
              .when(e == "click", F.concat(F.lit("plain "), u)).otherwise(F.concat(F.lit("["), e, F.lit("] "), u)))
    named = t.events.select("event_id", source.alias("source"))
    return named.select("event_id", X.source_to_notice_id("source").alias("notice_id"),
                        X.source_to_pdf("source").alias("pdf_name"))


@query("page_neighbours", f"""WITH {roles.SQL_PAGES}
SELECT source, page_index, page_num_raw, TRY_CAST(page_num_raw AS INTEGER) AS page_num,
  TRY_CAST(page_num_raw AS INTEGER) - 1 AS prev_page, TRY_CAST(page_num_raw AS INTEGER) + 1 AS next_page FROM rule_pages""")
def page_neighbours(t: Tables) -> DataFrame:
    pages = chunking.split_pages(roles.rule_files(t), "text")
    return pages.withColumns(chunking.page_columns(F.col("page_num_raw"))).select(
        "source", "page_index", "page_num_raw", "page_num", "prev_page", "next_page")


@query("page_window", f"""WITH {roles.SQL_HITS}
SELECT chunk_id, CASE WHEN page_num > 0 THEN array_to_string(list_sort(list_distinct([page_num, greatest(1, page_num - 1), page_num + 1])), ',')
  ELSE '1,2' END AS pages_10, CASE WHEN page_num > 0 THEN NULL ELSE '1' END AS default_4,
  CASE WHEN page_num > 0 THEN NULL ELSE '1,2,3' END AS default_25 FROM hits""")
def page_window(t: Tables) -> DataFrame:
    def joined(c):
        return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")

    h, page = roles.hits(t), F.col("page_num")
    return h.select("chunk_id", joined(C.page_window(page, 10)).alias("pages_10"),
                    F.when(~(page > 0), joined(C.page_window(page, 4))).alias("default_4"),
                    F.when(~(page > 0), joined(C.page_window(page, 25))).alias("default_25"))


@query("build_prompt", """SELECT item_id, 'Documents' || chr(10) || text || chr(10) || chr(10) || '[사용자 질문]' || chr(10) || 'item ' || item_id AS prompt FROM benchmark""")
def build_prompt(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", C.build_prompt(
        F.col("text"), F.concat(F.lit("item "), F.col("item_id").cast("string")), context_title="Documents\n").alias("prompt"))


@query("chat_messages", """SELECT u.conv_id, u.turn, 'user' AS first_role, u.text AS first_content, 'model' AS second_role, a.text AS second_content
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def chat_messages(t: Tables) -> DataFrame:
    said = t.conversations
    asked = said.filter("role = 'user'").select("conv_id", "turn", (F.col("turn") + 1).alias("n"), F.col("text").alias("u"))
    replied = said.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("n"), F.col("text").alias("a"))
    rows = asked.join(replied, ["conv_id", "n"]).select("conv_id", "turn", X.chat_messages(F.col("u"), F.col("a")).alias("m"))
    m = F.col("m")
    return rows.select("conv_id", "turn", m[0]["role"].alias("first_role"), m[0]["content"].alias("first_content"),
                       m[1]["role"].alias("second_role"), m[1]["content"].alias("second_content"))


@query("turn_template", f"""WITH {roles.SQL_LABELLED}
SELECT doc_id, '<start_of_turn>user' || chr(10) || question || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS open_turn,
  '<start_of_turn>user' || chr(10) || question || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || gold || '<end_of_turn>' AS full_turn
FROM labelled""")
def turn_template(t: Tables) -> DataFrame:
    return roles.labelled_questions(t).select(
        "doc_id", X.turn_template(F.col("question")).alias("open_turn"),
        X.turn_template(F.col("question"), F.col("gold")).alias("full_turn"))


@query("ensure_suffix", f"""SELECT conv_id, turn, CASE WHEN contains(text, 'en') THEN text
  ELSE rtrim(text, '{core.WHITE_SPACE}') || chr(10) || 'en' END AS prompt FROM conversations""")
def ensure_suffix(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.ensure_suffix("text", "\nen").alias("prompt"))


RAW_ROUTES = ("VISION", "text", "TEXT or VISION", "neither", "", "the VISION one", "텍스트", "비전 RAG", "[TEXT RAG]", "vision.")


@query("parse_route", f"""WITH raw AS (SELECT event_id, ({list(RAW_ROUTES)})[event_id % {len(RAW_ROUTES)} + 1] AS r FROM events)
SELECT event_id, CASE WHEN contains(upper(r), 'VISION') THEN 'VISION' ELSE 'TEXT' END AS vision_first,
  CASE WHEN contains(string_split(upper(r), ' ')[1], 'VISION') THEN 'VISION' ELSE 'TEXT' END AS first_token,
  CASE WHEN contains(lower(r), 'text') OR contains(r, '텍스트') THEN 'TEXT'
       WHEN contains(lower(r), 'vision') OR contains(r, '비전') OR contains(r, '비젼') THEN 'VISION' ELSE 'UNKNOWN' END AS text_first,
  CASE WHEN contains(upper(r), 'TEXT') THEN 'TEXT' ELSE 'VISION' END AS "binary" FROM raw""")
def parse_route(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(r) for r in RAW_ROUTES]), (F.pmod("event_id", F.lit(len(RAW_ROUTES))) + 1).cast("int"))
    named = t.events.select("event_id", raw.alias("raw"))
    return named.select("event_id", *[R.parse_route(F.col("raw"), m).alias(m)
                                      for m in ("vision_first", "first_token", "text_first", "binary")])


@query("first_ground_truth", f"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN ' ' WHEN role = 'system' THEN '정답 없음' ELSE text END AS a,
    CASE WHEN turn % 2 = 0 THEN NULL ELSE ' ' || text || ' ' END AS b, CASE WHEN turn < 4 THEN '정답 없음 ' ELSE role END AS c FROM conversations)
SELECT conv_id, turn, coalesce(nullif(nullif({sql_strip('a')}, ''), '정답 없음'), nullif(nullif({sql_strip('b')}, ''), '정답 없음'),
  nullif(nullif({sql_strip('c')}, ''), '정답 없음'), '') AS ground_truth FROM c""")
def first_ground_truth(t: Tables) -> DataFrame:
    role, text, turn = F.col("role"), F.col("text"), F.col("turn")
    a = F.when(role == "user", " ").when(role == "system", fixed.NO_ANSWER).otherwise(text)
    b = F.when(turn % 2 != 0, F.concat(F.lit(" "), text, F.lit(" ")))
    c = F.when(turn < 4, fixed.NO_ANSWER + " ").otherwise(role)
    return t.conversations.select("conv_id", "turn", X.first_ground_truth(a, b, c).alias("ground_truth"))


@query("first_route", f"""WITH {roles.SQL_ROUTES}
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN pred WHEN doc_id % 3 = 1 THEN gold ELSE '' END AS route FROM routes""")
def first_route(t: Tables) -> DataFrame:
    d = F.col("doc_id") % 3
    return roles.routes(t).select("doc_id", R.first_route(
        F.when(d == 0, F.concat(F.lit(" "), F.lower("pred"))).otherwise("n/a"), F.lit(None).cast("string"),
        F.when(d == 1, F.col("gold")).otherwise(""), F.when(d == 2, "other").otherwise("VISION"), default="").alias("route"))


@query("contexts_as_list", f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l, lang, source FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' OR len(l) = 0 THEN source ELSE array_to_string(l, '|') END AS contexts,
  CAST(CASE WHEN lang = 'en' OR len(l) = 0 THEN 1 ELSE len(l) END AS INTEGER) AS n FROM s""")
def contexts_as_list(t: Tables) -> DataFrame:
    texts = F.when(F.col("lang") != "en", F.split("text", "\n"))
    rows = t.documents.select("doc_id", C.contexts_as_list(
        texts, F.array(F.lit(" "), F.concat(F.col("source"), F.lit(" ")), F.lit(None).cast("string"))).alias("c"))
    return rows.select("doc_id", F.array_join("c", "|").alias("contexts"), F.size("c").alias("n"))


@query("fill_eval_defaults", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'No answer provided.' ELSE text END AS answer,
  CASE WHEN turn = 1 THEN role WHEN turn = 2 THEN text ELSE 'No context retrieved.' END AS contexts,
  CASE WHEN turn > 3 THEN 'No ground truth available.' ELSE text END AS ground_truth FROM conversations""")
def fill_eval_defaults(t: Tables) -> DataFrame:
    from ..operators.evaluation import fill_eval_defaults as fill

    role, text, turn = F.col("role"), F.col("text"), F.col("turn")
    rows = t.conversations.select(
        "conv_id", "turn", F.when(role == "assistant", text).when(role == "user", "").alias("answer"),
        text.alias("generated_answer"),
        F.when(turn == 1, F.array(role)).when(turn == 3, F.array().cast("array<string>")).alias("contexts"),
        F.when(turn == 2, F.array(text)).alias("retrieved_contexts"),
        F.when(turn <= 3, text).when(turn == 4, "").alias("ground_truth"))
    return fill(rows).select("conv_id", "turn", "answer", F.array_join("contexts", "|").alias("contexts"), "ground_truth")


CUES = ("By the table, ", "From the image, ", " (see the figure)", " - as charted")


@query("inject_cue", f"""WITH q AS (SELECT conv_id, turn, {sql_strip("CASE WHEN turn % 2 = 0 THEN text || '?' ELSE text END")} AS q, ({list(CUES)})[turn % 4 + 1] AS cue FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(cue, ' ') OR starts_with(cue, '(')
  THEN CASE WHEN ends_with(q, '?') THEN left(q, -1) || cue || '?' ELSE q || cue END ELSE cue || q END AS question, 'VISION' AS route FROM q""")
def inject_cue(t: Tables) -> DataFrame:
    asked = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", X.inject_cue(asked, F.col("turn"), CUES).alias("question"),
                                  F.lit(R.VISION).alias("route"))


def _sql_unwrapped(x: str) -> str:
    bare = sql_strip(f"regexp_replace({x}, '(?m)^```[A-Za-z]*[ \\t]*$|```', '', 'g')")
    return (f"CASE WHEN length({bare}) >= 2 AND starts_with({bare}, chr(34)) AND ends_with({bare}, chr(34)) "
            f"THEN substring({bare}, 2, length({bare}) - 2) ELSE {bare} END")


@query("strip_wrappers", f"""SELECT doc_id, {_sql_unwrapped("'```json' || chr(10) || text || chr(10) || '```'")} AS fenced,
  {_sql_unwrapped("' ' || chr(34) || text || chr(34)")} AS quoted, {_sql_unwrapped("text")} AS untouched FROM documents""")
def strip_wrappers(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    quoted = F.concat(F.lit(' "'), F.col("text"), F.lit('"'))
    return t.documents.select("doc_id", X.strip_wrappers(fenced).alias("fenced"),
                              X.strip_wrappers(quoted).alias("quoted"), X.strip_wrappers("text").alias("untouched"))


@query("parse_json_answer", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'REJECT' ELSE upper(event_type) END AS route,
  CASE WHEN event_type = 'error' THEN '' ELSE props END AS reason FROM events""")
def parse_json_answer(t: Tables) -> DataFrame:
    content = F.to_json(F.struct(F.col("event_type").alias("route"), F.col("props").alias("reason")))
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("not json "), content)).otherwise(content)
    return t.events.select("event_id", R.route_with_reason(broken).alias("r")).select("event_id", "r.route", "r.reason")


@query("parse_qa_pairs", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE 2 END AS pairs,
  CASE WHEN lang = 'fr' THEN '' ELSE text || '|' || lang END AS answers FROM documents""")
def parse_qa_pairs(t: Tables) -> DataFrame:
    pair = [F.struct(F.col("source").alias("question"), F.col(c).alias("answer")) for c in ("text", "lang")]
    content = F.to_json(F.struct(F.array(*pair).alias("qa_pairs")))
    broken = F.when(F.col("lang") == "fr", F.concat(F.lit("sorry, "), content)).otherwise(content)
    found = t.documents.select("doc_id", X.qa_pairs(broken).alias("found"))
    return found.select("doc_id", F.size("found").cast("bigint").alias("pairs"),
                        F.array_join(F.col("found.answer"), "|").alias("answers"))


@query("vision_footer", f"""SELECT doc_id, text || CASE WHEN lang = 'fr' THEN '{fixed.NO_PAGES_TITLE}' || '{fixed.NO_PAGES_LINE}'
  ELSE '{fixed.PAGES_TITLE}- ' || source || chr(10) || '- ' || lang END AS answer FROM documents""")
def vision_footer(t: Tables) -> DataFrame:
    with_images = F.col("lang") != "fr"
    pages = F.when(with_images, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    return t.documents.select("doc_id", C.vision_footer(F.col("text"), pages, with_images).alias("answer"))


@query("source_footer", """SELECT doc_id, CASE WHEN lang = 'fr' THEN text || '📚' ELSE text || chr(10) || chr(10) || '📚 **[참고 문헌 및 근거 자료]**' || chr(10)
  || CASE WHEN lang < source THEN '- ' || lang || chr(10) || '- ' || source ELSE '- ' || source || chr(10) || '- ' || lang END END AS answer FROM documents""")
def source_footer(t: Tables) -> DataFrame:
    answer = F.when(F.col("lang") == "fr", F.concat("text", F.lit("📚"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", C.source_footer(answer, F.array("source", "lang", "source")).alias("answer"))


@query("format_metric", """SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE printf('%.3f', value / 512) END AS metric,
  printf('%.2f', value) AS latency FROM events""")
def format_metric(t: Tables) -> DataFrame:
    metric = F.when(F.col("event_type") != "error", F.col("value") / 512)
    return t.events.select("event_id", X.format_metric(metric).alias("metric"),
                           X.format_metric(F.col("value"), 2).alias("latency"))


@query("strip_instruction", f"""SELECT conv_id, turn, {sql_strip('text')} AS question FROM conversations""")
def strip_instruction(t: Tables) -> DataFrame:
    full = F.concat(F.lit("Question: "), F.col("text"), F.lit("\nWhich mode?\nTEXT"))
    return t.conversations.select("conv_id", "turn", X.strip_instruction(full, "\nWhich mode?", "Question: ").alias("question"))


# --- predicates ---

@query("verify_rows", f"""WITH {roles.SQL_LABELLED}
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected
FROM (SELECT length(question) > 25 AND gold = pred AS ok FROM labelled)""")
def verify_rows(t: Tables) -> DataFrame:
    rows = roles.labelled_questions(t).withColumn("route", F.when(F.col("gold") == F.col("pred"), F.col("gold")))
    return filters.verify_counts(rows, filters.verified(F.col("question"), [F.col("route")], min_length=25))


@query("complete_rows", f"""WITH {roles.SQL_QA}
SELECT qa_id FROM qa WHERE {sql_strip("CASE WHEN turn > 3 THEN ' ' ELSE question END")} <> '' AND {sql_strip('answer')} <> '' AND {sql_strip('ground_truth')} <> ''""")
def complete_rows(t: Tables) -> DataFrame:
    question = F.when(F.col("turn") > 3, " ").otherwise(F.col("question"))
    return roles.qa(t).filter(filters.complete(question, F.col("answer"), F.col("ground_truth"))).select("qa_id")


@query("keep_labels", """SELECT doc_id, CASE WHEN quality = 1 THEN 'TEXT' ELSE 'VISION' END AS route FROM labels WHERE toxic = 0""")
def keep_labels(t: Tables) -> DataFrame:
    rows = roles.routes(t).join(t.labels.select("doc_id", "toxic"), "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, R.REJECT).otherwise(F.col("gold")).alias("route"))
    return filters.keep_labels(rows, "route")


@query("error_rows", """SELECT event_id FROM events WHERE event_type = 'error' OR (event_type = 'view' AND value > 100)""")
def error_rows(t: Tables) -> DataFrame:
    first = F.when(F.col("event_type") == "error", F.concat(F.lit("API Error: "), "props")).otherwise(F.col("props"))
    second = F.when((F.col("event_type") == "view") & (F.col("value") > 100), "API Error: late")
    return t.events.filter(filters.has_error(first, second)).select("event_id")


@query("low_text_pages", f"""WITH {roles.SQL_PAGES}
SELECT doc_id, page_index, length({sql_strip('line')}) < 5 AS needs_ocr FROM lines""")
def low_text_pages(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("page_index"),
                        filters.needs_ocr(F.col("line")).alias("needs_ocr"))


@query("file_predicate", f"""WITH {roles.SQL_MEDIA}
SELECT path FROM media WHERE (lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.png') AND NOT regexp_matches(path, '^src1_')""")
def file_predicate(t: Tables) -> DataFrame:
    return roles.media(t).filter(filters.file_matches(F.col("path"), (".pdf", ".png"), excluded="^src1_")).select("path")


@query("date_cutoff", """SELECT event_id FROM events WHERE event_type = 'signup' OR CAST(ts AS DATE) >= DATE '2024-01-15'""")
def date_cutoff(t: Tables) -> DataFrame:
    pinned = F.col("event_type") == "signup"
    return t.events.filter(filters.on_or_after(F.to_date("ts"), F.lit("2024-01-15").cast("date"), pinned)).select("event_id")


@query("finite_vectors", """SELECT vec_id FROM embeddings WHERE label <> 3 AND label <> 5 AND label <> 7""")
def finite_vectors(t: Tables) -> DataFrame:
    from ..operators.dense import finite_vectors as finite

    def first(value):
        return F.concat(F.array(F.lit(value).cast("float")), F.slice("embedding", 2, 63))

    broken = (F.when(F.col("label") == 3, first(float("nan"))).when(F.col("label") == 5, first(float("-inf")))
              .when(F.col("label") == 7, first(None)).otherwise(F.col("embedding")))
    return finite(t.embeddings.select("vec_id", broken.alias("vector")), "vector").select("vec_id")


@query("label_only_contexts", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: length({sql_strip('x')})), lambda n: n > 0) AS ls FROM documents)
SELECT doc_id, len(list_filter(ls, lambda n: n >= 120)) = 0 AS label_only FROM l""")
def label_only_contexts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.label_only_contexts(C.clean_list(F.split("text", "\n"))).alias("label_only"))


@query("drop_unscored", f"""WITH {roles.SQL_RUNS}
SELECT event_id, faithfulness FROM runs WHERE faithfulness IS NOT NULL AND pipeline <> 'error'""")
def drop_unscored(t: Tables) -> DataFrame:
    runs = roles.scored_runs(t).withColumn("answer_correctness",
                                           F.when(F.col("pipeline") != "error", F.col("answer_correctness")))
    return filters.drop_unscored(runs, ["faithfulness", "answer_correctness"]).select("event_id", "faithfulness")


@query("evaluable_rows", f"""WITH {roles.SQL_QA}
SELECT count(*) FILTER (WHERE turn <= 4 AND conv_id % 3 <> 0) AS ok, count(*) FILTER (WHERE turn > 4) AS no_question,
  count(*) FILTER (WHERE turn <= 4 AND conv_id % 3 = 0) AS no_truth FROM qa""")
def evaluable_rows(t: Tables) -> DataFrame:
    question = F.when(F.col("turn") <= 4, F.col("question")).otherwise(" \n")
    truth = F.when(F.col("conv_id") % 3 != 0, F.col("ground_truth"))
    state = roles.qa(t).select(filters.evaluable(question, truth).alias("state"))
    return state.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("ok", "no_question", "no_truth")])


@query("length_violations", """SELECT doc_id, CASE WHEN strlen(text) > 4000 AND strlen(source) > 4 THEN 'chunk_text,entity'
  WHEN strlen(text) > 4000 THEN 'chunk_text' ELSE 'entity' END AS offending FROM documents WHERE strlen(text) > 4000 OR strlen(source) > 4""")
def length_violations(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("text").alias("chunk_text"), F.col("source").alias("entity"))
    found = filters.length_violations(rows, {"chunk_text": 4000, "entity": 4})
    return found.select("doc_id", F.array_join("offending", ",").alias("offending"))


# --- chunkers ---

@query("paragraph_chunks", f"""WITH {roles.SQL_CHUNKS} SELECT doc_id, chunk_no, chunk FROM chunks""")
def paragraph_chunks(t: Tables) -> DataFrame:
    return chunking.paragraph_chunks(spread(t.documents, "doc_id").select("doc_id", "text"), "text", separator=roles.LINES)


@query("chunk_index", f"""WITH {roles.SQL_CHUNKS} SELECT chunk_id, parent_id, chunk_no FROM notice_chunks""")
def chunk_index(t: Tables) -> DataFrame:
    return chunking.notice_chunks(roles.notices(t), separator=roles.LINES).select("chunk_id", "parent_id", "chunk_no")


@query("notice_chunks", f"""WITH {roles.SQL_CHUNKS}
SELECT chunk_id, parent_id, chunk_no, '' AS year, category, '' AS target, entity, chunk_text FROM notice_chunks""")
def notice_chunks(t: Tables) -> DataFrame:
    return chunking.notice_chunks(roles.notices(t), separator=roles.LINES)


@query("split_pages", f"""WITH {roles.SQL_PAGES} SELECT source, page_index, doc_id, page_num_raw, page_text FROM rule_pages""")
def split_pages(t: Tables) -> DataFrame:
    return chunking.split_pages(roles.rule_files(t), "text")


@query("bounded_chunks", f"""WITH {roles.SQL_RULE_CHUNKS} SELECT source, page_index, chunk_no, text FROM rule_chunks""")
def bounded_chunks(t: Tables) -> DataFrame:
    return chunking.rule_chunks(roles.rule_files(t), "text", "source").select("source", "page_index", "chunk_no", "text")


@query("rule_chunks", f"""WITH {roles.SQL_RULE_CHUNKS}
SELECT source, page_index, doc_id, page_num_raw, page_num, page_num - 1 AS prev_page, page_num + 1 AS next_page, chunk_no, text FROM rule_chunks""")
def rule_chunks(t: Tables) -> DataFrame:
    return chunking.rule_chunks(roles.rule_files(t), "text", "source")


@query("chunk_stats", f"""WITH {roles.SQL_CHUNKS}, per AS (SELECT parent_id, count(*) AS n FROM notice_chunks GROUP BY 1)
SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, max(n) AS most, round(avg(n), 6) AS chunks_per_document FROM per""")
def chunk_stats(t: Tables) -> DataFrame:
    from ..operators.reports import chunk_stats as stats

    return stats(chunking.notice_chunks(roles.notices(t), separator=roles.LINES))


@query("token_cost", f"""WITH {roles.SQL_CHUNKS}, s AS (SELECT count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS characters FROM chunks)
SELECT chunks, characters, characters * 1.5::DOUBLE + chunks * 50 AS input_tokens, characters * 1.5::DOUBLE AS output_tokens,
  round((characters * 1.5::DOUBLE + chunks * 50) / 1e6 * 0.15 + characters * 1.5::DOUBLE / 1e6 * 0.6, 6) AS cost,
  round(((characters * 1.5::DOUBLE + chunks * 50) / 1e6 * 0.15 + characters * 1.5::DOUBLE / 1e6 * 0.6) * 1350, 6) AS cost_local FROM s""")
def token_cost(t: Tables) -> DataFrame:
    return chunking.token_cost(chunking.paragraph_chunks(
        spread(t.documents, "doc_id").select("doc_id", "text"), "text", separator=roles.LINES), "chunk")

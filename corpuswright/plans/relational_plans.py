"""Joins, aggregates, windows, orders, sets, media budgets and dataset builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import core, text as X
from ..operators import (datasets, evaluation, joins, media as M, ordinals, reports, routing, sampling, search)
from . import roles
from .registry import Tables, query
from .roles import sql_norm, sql_strip


# --- joins ---

@query("rejoin_ground_truth", f"""WITH last AS (
  SELECT {sql_strip('text')} AS q, max_by(source, doc_id) AS truth FROM documents
  WHERE {sql_strip('text')} <> '' AND lang <> 'de' GROUP BY 1)
SELECT d.doc_id, coalesce(l.truth, d.lang) AS ground_truth, l.truth IS NOT NULL AS matched
FROM documents d LEFT JOIN last l ON l.q = {sql_strip('d.text')}""")
def rejoin_ground_truth(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.concat(F.lit(" "), F.col("text")).alias("question"), F.col("lang").alias("ground_truth"))
    verified = t.documents.select(F.col("text").alias("question"), F.col("doc_id").alias("ordinal"),
                                  F.when(F.col("lang") != "de", F.col("source")).otherwise(" ").alias("ground_truth"))
    return joins.rejoin_ground_truth(rows, verified).select("doc_id", "ground_truth", "matched")


@query("match_coverage", f"""WITH known AS (SELECT text FROM documents),
  raw AS (SELECT DISTINCT {sql_strip('text')} AS k FROM known), norm AS (SELECT DISTINCT {sql_norm('text')} AS k FROM known),
  asked AS (SELECT replace(text, ' ', '  ') AS spaced, text, lang FROM documents UNION ALL SELECT text, text, '' FROM benchmark),
  keyed AS (SELECT CASE WHEN lang = 'en' THEN spaced ELSE text END AS q FROM asked)
SELECT count(*) AS asked, count(*) FILTER (WHERE {sql_strip('q')} IN (SELECT k FROM raw)) AS raw_hits,
  count(*) FILTER (WHERE {sql_norm('q')} IN (SELECT k FROM norm)) AS normalised_hits,
  count(*) FILTER (WHERE {sql_norm('q')} NOT IN (SELECT k FROM norm)) AS misses FROM keyed""")
def match_coverage(t: Tables) -> DataFrame:
    spaced = F.when(F.col("lang") == "en", F.replace(F.col("text"), F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    asked = t.documents.select(spaced.alias("q")).unionByName(t.benchmark.select(F.col("text").alias("q")))
    return joins.match_coverage(asked, t.documents, "q", "text")


@query("coverage_misses", f"""WITH norm AS (SELECT DISTINCT {sql_norm('text')} AS k FROM documents),
  asked AS (SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)
SELECT origin, id FROM asked WHERE {sql_norm('text')} NOT IN (SELECT k FROM norm)""")
def coverage_misses(t: Tables) -> DataFrame:
    asked = (t.documents.select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")
             .unionByName(t.benchmark.select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")))
    return joins.coverage_misses(asked, t.documents, "text", "text").select("origin", "id")


@query("reverse_eval_pairs", f"""WITH {roles.SQL_QA}
SELECT qa_id, 'text_answer' AS dataset, question, answer, ground_truth AS new_truth FROM qa
UNION ALL SELECT qa_id, 'original_truth', question, question, ground_truth FROM qa""")
def reverse_eval_pairs(t: Tables) -> DataFrame:
    pairs = roles.qa(t)
    vision = pairs.select("qa_id", F.col("ground_truth").alias("answer"))
    text = pairs.select("qa_id", "question", "answer", "contexts", F.col("question").alias("ground_truth"))
    first, second = joins.reverse_eval_pairs(vision, text, "qa_id")
    both = first.withColumn("dataset", F.lit("text_answer")).unionByName(second.withColumn("dataset", F.lit("original_truth")))
    return both.select("qa_id", "dataset", "question", "answer", F.col("ground_truth").alias("new_truth"))


@query("add_latency", f"""WITH {roles.SQL_RUNS}, s AS (SELECT pipeline, round(avg(answer_correctness), 6) AS answer_correctness FROM runs GROUP BY 1),
  l AS (SELECT pipeline, round(avg(latency), 4) AS latency FROM runs GROUP BY 1)
SELECT * FROM s LEFT JOIN l USING (pipeline)""")
def add_latency(t: Tables) -> DataFrame:
    runs = roles.scored_runs(t)
    latencies = runs.groupBy("pipeline").agg(F.round(F.avg("latency"), 4).alias("latency"))
    return joins.add_latency(reports.metric_means(runs, ["answer_correctness"], ["pipeline"]), latencies)


@query("expand_to_neighbours", f"""WITH {roles.SQL_HITS}, w AS (
  SELECT DISTINCT query_id, doc_id, unnest(CASE WHEN page_num > 0 THEN [greatest(1, page_num - 1), page_num, page_num + 1] ELSE [1, 2] END) AS page_num FROM hits),
  p AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_num, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT DISTINCT w.query_id, w.doc_id, w.page_num, p.text FROM w JOIN p ON w.doc_id = p.doc_id AND w.page_num = p.page_num""")
def expand_to_neighbours(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        "doc_id", (F.col("i") + 1).cast("int").alias("page_num"), "text")
    return joins.expand_to_neighbours(roles.hits(t), pages).select(
        "query_id", "doc_id", F.col("page_num").cast("bigint").alias("page_num"), "text")


@query("chunk_to_parent", f"""WITH {roles.SQL_CHUNKS}
SELECT chunk_id, d.n_chars, d.lang FROM notice_chunks c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.parent_id""")
def chunk_to_parent(t: Tables) -> DataFrame:
    from ..operators.chunking import notice_chunks

    chunks = notice_chunks(roles.notices(t), separator=roles.LINES).select("chunk_id", "parent_id")
    parents = t.documents.select(F.col("doc_id").cast("string").alias("parent_id"), "n_chars", "lang")
    return joins.chunk_to_parent(chunks, parents).select("chunk_id", "n_chars", "lang")


@query("resume_anti", """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_anti(t: Tables) -> DataFrame:
    return joins.resume_anti(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("unused_pages", f"""WITH {roles.SQL_HITS}, p AS (
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents)
SELECT doc_id, page FROM p WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = p.doc_id AND h.page_num = p.page)""")
def unused_pages(t: Tables) -> DataFrame:
    notes = roles.hits(t).select("doc_id", F.concat(F.lit("file "), F.col("page_num").cast("string"), F.lit("페이지")).alias("note"))
    used = notes.select("doc_id", joins.used_page(F.col("note")).alias("page"))
    documents = t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("pages"))
    return joins.unused_pages(documents, used)


@query("repair_rows", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'fixed ' || user_id ELSE props END AS answer FROM events""")
def repair_rows(t: Tables) -> DataFrame:
    from ..operators.filters import has_error

    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "error", F.concat(F.lit("API Error "), "props"))
                           .otherwise(F.col("props")).alias("answer"))
    repaired = rows.filter(has_error(F.col("answer"))).select(
        "event_id", F.concat(F.lit("fixed "), F.col("user_id").cast("string")).alias("answer"))
    return joins.repair_rows(rows, repaired, ["event_id"], ["answer"]).select("event_id", "answer")


@query("doc_path_lookup", """SELECT e.event_id, CASE WHEN d.doc_id IS NULL THEN NULL ELSE d.source || '.pdf' END AS path,
  CAST(CASE d.doc_id % 3 WHEN 1 THEN d.doc_id WHEN 2 THEN 1 END AS INTEGER) AS page_num
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id""")
def doc_path_lookup(t: Tables) -> DataFrame:
    d, path = F.col("doc_id"), F.concat("source", F.lit(".pdf"))
    entry = (F.when(d % 3 == 0, path)
             .when(d % 3 == 1, F.concat(F.lit('["'), path, F.lit('", '), d.cast("string"), F.lit("]")))
             .otherwise(F.concat(F.lit('{"path": "'), path, F.lit('"}'))))
    stored = t.documents.select("doc_id", joins.parse_path_entry(entry).alias("e"))
    ids = t.events.select("event_id", F.col("event_id").alias("doc_id"))
    return joins.doc_path_lookup(ids, stored.select("doc_id", "e.path", "e.page_num")).select("event_id", "path", "page_num")


@query("choose_by_route", f"""WITH {roles.SQL_LABELLED}
SELECT doc_id, CASE WHEN pred = 'TEXT' THEN question ELSE gold END AS answer FROM labelled""")
def choose_by_route(t: Tables) -> DataFrame:
    return joins.choose_by_route(roles.labelled_questions(t), "pred", {"answer": ("question", "gold")}).select("doc_id", "answer")


# --- media ---

@query("media_sets", f"""WITH {roles.SQL_HITS}, {roles.SQL_MEDIA}
SELECT h.query_id, count(DISTINCT (h.doc_id, m.path)) AS files FROM hits h JOIN media m USING (doc_id) WHERE lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.png' GROUP BY 1""")
def media_sets(t: Tables) -> DataFrame:
    """Files of every query's documents, counted from bitmaps."""
    sets, _ = M.media_sets(roles.hits(t), roles.media(t))
    return sets.groupBy("query_id").agg(F.sum(F.bitmap_count("files")).alias("files"))


@query("hits_to_media", f"""WITH {roles.SQL_HITS}, {roles.SQL_MEDIA}
SELECT DISTINCT h.query_id, h.doc_id, m.path FROM hits h JOIN media m USING (doc_id) WHERE lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.png'""")
def hits_to_media(t: Tables) -> DataFrame:
    return M.hits_to_media(roles.hits(t), roles.media(t)).select("query_id", "doc_id", "path")


@query("sort_media", f"""WITH {roles.SQL_MEDIA}
SELECT path, row_number() OVER (ORDER BY lower(path) LIKE '%.pdf', path) AS place FROM media""")
def sort_media(t: Tables) -> DataFrame:
    files = roles.media(t)
    placed = ordinals.with_ordinal(files, "place", [M.is_pdf(F.col("path")), F.col("path")])
    return M.sort_media(placed).select("path", "place")


@query("first_seen_order", f"""WITH {roles.SQL_HITS}, b AS (SELECT query_id, doc_id, min(rank) AS best_rank FROM ranked GROUP BY 1, 2)
SELECT query_id, doc_id, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY best_rank) AS doc_rank FROM b""")
def first_seen_order(t: Tables) -> DataFrame:
    return M.first_seen_order(ranked_hits(t).drop("page_num"))


def ranked_hits(t: Tables) -> DataFrame:
    return ordinals.with_ordinal(roles.hits(t), "rank", [-F.col("score"), F.col("chunk_id")], [F.col("query_id")])


@query("media_budget", f"""WITH {roles.SQL_HITS}, {roles.SQL_MEDIA},
  b AS (SELECT query_id, doc_id, min(rank) AS r, min_by(page_num, rank) FILTER (WHERE page_num > 0) AS page FROM ranked GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS doc_rank FROM b),
  f AS (SELECT query_id, doc_id, path, doc_rank, lower(path) LIKE '%.pdf' AS pdf,
        unnest(CASE WHEN lower(path) LIKE '%.png' THEN [0] WHEN page IS NULL THEN [1, 2] ELSE list_distinct([greatest(1, page - 1), page, page + 1]) END) AS page
        FROM o JOIN media m USING (doc_id) WHERE lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.png'),
  s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, pdf, path, page) AS slot FROM f)
SELECT query_id, doc_id, path, CAST(page AS INTEGER) AS page, slot FROM s WHERE slot <= 10""")
def media_budget(t: Tables) -> DataFrame:
    return M.media_budget(ranked_hits(t), roles.media(t))


SQL_TARGETS = roles.SQL_HITS + """,
targets AS (SELECT query_id, rank, page_num, CASE WHEN doc_id % 2 = 0 THEN 'rules' ELSE 'notice' END AS kind,
  CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id || '.pdf' ELSE CAST(doc_id AS VARCHAR) END AS target FROM ranked),
firsts AS (SELECT query_id, kind, target, min(rank) AS first_rank FROM targets GROUP BY 1, 2, 3)"""


def _targets(t: Tables) -> DataFrame:
    d = F.col("doc_id").cast("string")
    source = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("rules/r"), d, F.lit(".md"))).otherwise(
        F.concat(F.lit("[공지사항-일반] "), d))
    return ranked_hits(t).withColumn("source", source)


@query("media_budget_docs", f"""WITH {SQL_TARGETS},
  d AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY first_rank) AS doc_rank FROM firsts),
  closing AS (SELECT query_id, kind, first_rank AS closed_at FROM d WHERE doc_rank = 3),
  p AS (SELECT t.query_id, t.kind, t.target, CASE WHEN t.kind = 'rules' THEN page_num END AS page, min(rank) AS page_first FROM targets t GROUP BY ALL),
  pp AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id, p.kind, target ORDER BY page_first) AS page_slot
         FROM p LEFT JOIN closing c USING (query_id, kind) WHERE closed_at IS NULL OR page_first <= closed_at)
SELECT query_id, kind, target, doc_rank, page, page_slot FROM d JOIN pp USING (query_id, kind, target) WHERE doc_rank <= 3 AND page_slot <= 2""")
def media_budget_docs(t: Tables) -> DataFrame:
    return M.media_budget_docs(_targets(t), 3, 2, combined=False)


@query("media_budget_docs_combined", f"""WITH {SQL_TARGETS},
  d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS doc_rank FROM firsts),
  p AS (SELECT t.query_id, t.kind, t.target, CASE WHEN t.kind = 'rules' THEN page_num END AS page, min(rank) AS page_first FROM targets t GROUP BY ALL),
  pp AS (SELECT p.*, row_number() OVER (PARTITION BY query_id, kind, target ORDER BY page_first) AS page_slot FROM p)
SELECT query_id, kind, target, doc_rank, page, page_slot FROM d JOIN pp USING (query_id, kind, target) WHERE doc_rank <= 5 AND page_slot <= 3""")
def media_budget_docs_combined(t: Tables) -> DataFrame:
    return M.media_budget_docs(_targets(t), 5, 3, combined=True)


@query("unique_pages", f"""WITH {roles.SQL_HITS}
SELECT query_id, source, page_num, min(rank) AS first_rank FROM ranked GROUP BY 1, 2, 3""")
def unique_pages(t: Tables) -> DataFrame:
    return M.unique_pages(ranked_hits(t))


# --- aggregates ---

@query("corpus_profile", """WITH p AS (SELECT page_id, page_id % 10 <> 0 AS known, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS a,
  len(regexp_extract_all(html, '<p>')) AS i FROM pages)
SELECT count(*) AS total_notices, count(*) FILTER (WHERE NOT known) AS missing_info, count(*) FILTER (WHERE known AND a > 0) AS with_attachments,
  count(*) FILTER (WHERE known AND i > 0) AS with_images, CAST(sum(CASE WHEN known THEN a END) AS BIGINT) AS attachment_files,
  CAST(sum(CASE WHEN known THEN i END) AS BIGINT) AS image_files FROM p""")
def corpus_profile(t: Tables) -> DataFrame:
    return reports.corpus_profile(_profiled(t))


def _profiled(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", (F.col("page_id") % 10 != 0).alias("has_info"),
        F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1)).alias("attachments"),
        F.regexp_extract_all("html", F.lit("<p>"), F.lit(0)).alias("images"))


@query("missing_info", "SELECT page_id FROM pages WHERE page_id % 10 = 0")
def missing_info(t: Tables) -> DataFrame:
    return reports.missing_info(_profiled(t), "page_id")


@query("label_counts", f"""WITH {roles.SQL_ROUTES} SELECT gold, pred, count(*) AS rows FROM routes GROUP BY 1, 2""")
def label_counts(t: Tables) -> DataFrame:
    return reports.label_counts(roles.routes(t), "gold", "pred")


@query("metric_means", f"""WITH {roles.SQL_RUNS}
SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_correctness), 6) AS answer_correctness, 0.0::DOUBLE AS context_recall FROM runs""")
def metric_means(t: Tables) -> DataFrame:
    return reports.metric_means(roles.scored_runs(t), ["faithfulness", "answer_correctness", "context_recall"])


@query("pipeline_summary", f"""WITH {roles.SQL_RUNS}
SELECT pipeline, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_correctness), 6) AS answer_correctness FROM runs GROUP BY 1""")
def pipeline_summary(t: Tables) -> DataFrame:
    return reports.metric_means(roles.scored_runs(t), ["faithfulness", "answer_correctness"], ["pipeline"])


@query("metric_long_form", f"""WITH {roles.SQL_RUNS}, w AS (
  SELECT 'before' AS condition, * FROM runs WHERE pipeline IN ('view', 'click') UNION ALL SELECT 'after', * FROM runs WHERE pipeline NOT IN ('view', 'click'))
SELECT condition, 'faithfulness' AS metric, round(avg(faithfulness), 6) AS score FROM w GROUP BY 1
UNION ALL SELECT condition, 'answer_correctness', round(avg(answer_correctness), 6) FROM w GROUP BY 1""")
def metric_long_form(t: Tables) -> DataFrame:
    runs, early = roles.scored_runs(t), F.col("pipeline").isin("view", "click")
    return reports.metric_long_form({"before": runs.filter(early), "after": runs.filter(~early)},
                                    ["faithfulness", "answer_correctness"])


SQL_THREE = roles.SQL_ROUTES + """,
judged AS (SELECT gold, CASE WHEN doc_id % 9 = 0 THEN 'UNKNOWN' ELSE pred END AS pred FROM routes)"""


def _judged(t: Tables) -> DataFrame:
    return roles.routes(t).withColumn("pred", F.when(F.col("doc_id") % 9 == 0, "UNKNOWN").otherwise(F.col("pred")))


@query("confusion_matrix", f"""WITH {SQL_THREE}
SELECT gold AS actual, count(*) FILTER (WHERE (gold = 'TEXT' AND pred = 'TEXT') OR (gold = 'VISION' AND pred <> 'VISION')) AS pred_text,
  count(*) FILTER (WHERE (gold = 'VISION' AND pred = 'VISION') OR (gold = 'TEXT' AND pred <> 'TEXT')) AS pred_vision FROM judged GROUP BY 1""")
def confusion_matrix(t: Tables) -> DataFrame:
    return reports.confusion_matrix(_judged(t), "gold", "pred")


@query("accuracy_by_class", f"""WITH {SQL_THREE}
SELECT count(*) AS samples, round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS accuracy,
  round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE gold = 'TEXT') * 100, 6) AS text_accuracy,
  round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE gold = 'VISION') * 100, 6) AS vision_accuracy FROM judged""")
def accuracy_by_class(t: Tables) -> DataFrame:
    return reports.accuracy_by_class(reports.confusion_matrix(_judged(t), "gold", "pred"))


@query("classification_report", f"""WITH {SQL_THREE}, c AS (
  SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS hit, count(*) FILTER (WHERE pred = label) AS named,
    count(*) FILTER (WHERE gold = label) AS support FROM judged, (VALUES ('TEXT'), ('VISION')) v(label) GROUP BY 1),
  s AS (SELECT label, coalesce(hit / nullif(named, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support FROM c),
  f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM s)
SELECT label, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(t: Tables) -> DataFrame:
    return reports.classification_report(_judged(t), "gold", "pred")


SQL_ROUTE_RUNS = roles.SQL_QA + """,
route_runs AS (SELECT qa_id, conv_id, CASE WHEN turn <= 4 THEN question END AS question, CASE WHEN conv_id % 5 <> 0 THEN ground_truth ELSE '' END AS truth,
  CASE conv_id % 3 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'VISION' ELSE '' END AS gold, CASE WHEN contains(question, 'en') THEN 'VISION' ELSE 'TEXT' END AS pred,
  length(question) / 100 AS tl, length(answer) / 50 AS vl FROM qa)"""


def _route_runs(t: Tables) -> DataFrame:
    c = F.col
    return roles.qa(t).select(
        "qa_id", F.when(c("turn") <= 4, c("question")).alias("question"),
        F.when(c("conv_id") % 5 != 0, c("ground_truth")).otherwise("").alias("ground_truth"),
        F.when(c("conv_id") % 3 == 0, "TEXT").when(c("conv_id") % 3 == 1, "VISION").otherwise("").alias("route_gold"),
        F.when(c("question").contains("en"), "VISION").otherwise("TEXT").alias("route_pred"),
        (F.length("question") / 100).alias("text_latency"), (F.length("answer") / 50).alias("vision_latency"),
    ).withColumn("tv_latency", F.when(c("route_pred") == "TEXT", c("text_latency")).otherwise(c("vision_latency")))


@query("route_eval_summary", f"""WITH {SQL_ROUTE_RUNS}, k AS (SELECT *, question IS NOT NULL AND truth <> '' AS ok FROM route_runs)
SELECT count(*) FILTER (WHERE ok) AS processed, count(*) FILTER (WHERE question IS NULL) AS skipped_no_question,
  count(*) FILTER (WHERE question IS NOT NULL AND truth = '') AS skipped_no_truth, count(*) FILTER (WHERE ok AND gold <> '') AS route_total,
  count(*) FILTER (WHERE ok AND gold = pred) AS route_correct,
  round(count(*) FILTER (WHERE ok AND gold = pred) / count(*) FILTER (WHERE ok AND gold <> ''), 4) AS route_accuracy,
  round(avg(tl) FILTER (WHERE ok), 4) AS avg_text_latency, round(avg(vl) FILTER (WHERE ok), 4) AS avg_vision_latency,
  round(avg(CASE WHEN pred = 'TEXT' THEN tl ELSE vl END) FILTER (WHERE ok), 4) AS avg_tv_latency FROM k""")
def route_eval_summary(t: Tables) -> DataFrame:
    return reports.route_eval_summary(_route_runs(t))


@query("prediction_precision", f"""WITH {SQL_THREE}
SELECT count(*) AS predicted, count(*) FILTER (WHERE gold = 'VISION') AS hits, count(*) FILTER (WHERE gold <> 'VISION') AS false_alarms,
  round(count(*) FILTER (WHERE gold = 'VISION') / count(*), 6) AS "precision" FROM judged WHERE pred = 'VISION'""")
def prediction_precision(t: Tables) -> DataFrame:
    return reports.prediction_precision(_judged(t), "gold", "pred")


@query("speedup_summary", """SELECT count(*) AS runs, round(avg(value / (event_id % 7)), 6) AS mean_speedup,
  round(avg(CAST(event_id % 7 AS DOUBLE)), 6) AS mean_staged FROM (SELECT value, nullif(event_id, -1) AS event_id FROM events WHERE event_id % 7 <> 0
  UNION ALL SELECT NULL, event_id FROM events WHERE event_id % 7 = 0)""")
def speedup_summary(t: Tables) -> DataFrame:
    runs = t.events.select("value", F.pmod("event_id", F.lit(7)).cast("double").alias("staged"))
    return reports.speedup_summary(runs, "value", "staged")


@query("sources_per_query", f"""WITH {roles.SQL_HITS}
SELECT query_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ranked WHERE rank <= 7 GROUP BY 1""")
def sources_per_query(t: Tables) -> DataFrame:
    best = search.rank_by_score(roles.hits(t), "query_id", "score", "chunk_id", 7)
    return reports.sources_per_query(best).select("query_id", F.array_join("sources", ",").alias("sources"))


@query("batch_outcome", """SELECT event_type, count(*) AS processed, count(*) FILTER (WHERE value < 60) AS succeeded,
  count(*) FILTER (WHERE value >= 60) AS failed FROM events GROUP BY 1""")
def batch_outcome(t: Tables) -> DataFrame:
    return reports.batch_outcome(t.events, F.col("value") < 60, ["event_type"])


@query("failed_items", "SELECT event_id FROM events WHERE value >= 60")
def failed_items(t: Tables) -> DataFrame:
    return reports.failed_items(t.events, F.col("value") < 60, "event_id")


@query("zero_shot_accuracy", f"""WITH {SQL_THREE}
SELECT count(*) AS total, count(*) FILTER (WHERE gold = pred) AS correct, round(count(*) FILTER (WHERE gold = pred) / count(*), 6) AS accuracy FROM judged""")
def zero_shot_accuracy(t: Tables) -> DataFrame:
    return reports.zero_shot_accuracy(_judged(t), "gold", "pred")


@query("session_history", """SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""")
def session_history(t: Tables) -> DataFrame:
    return evaluation.session_history(t.conversations, "conv_id", [F.col("turn")]).select("conv_id", "role", "text", "position")


@query("join_chunks", """WITH s AS (SELECT conv_id, min(turn) AS stop FROM conversations WHERE turn >= 5 AND role = 'assistant' GROUP BY 1)
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS pieces FROM conversations LEFT JOIN s USING (conv_id)
WHERE stop IS NULL OR turn < stop GROUP BY 1""")
def join_chunks(t: Tables) -> DataFrame:
    end = (F.col("turn") >= 5) & (F.col("role") == "assistant")
    return evaluation.join_chunks(t.conversations, "conv_id", "turn", "text", end=end, per_block=2)


# --- windows and orders ---

@query("renumber", """SELECT conv_id, turn, row_number() OVER (ORDER BY role, conv_id, turn) - 1 AS id FROM conversations""")
def renumber(t: Tables) -> DataFrame:
    c = F.col
    return sampling.renumber(t.conversations.select("conv_id", "turn", "role"), "id",
                             [c("role"), c("conv_id"), c("turn")]).select("conv_id", "turn", "id")


@query("rank_hits", f"""WITH {roles.SQL_HITS} SELECT query_id, chunk_id, score, rank FROM ranked""")
def rank_hits(t: Tables) -> DataFrame:
    return ranked_hits(t).select("query_id", "chunk_id", "score", "rank")


@query("keep_last", """SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2""")
def keep_last(t: Tables) -> DataFrame:
    return joins.keep_last(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("running_progress", """SELECT event_id, sum(1) OVER w AS processed, CAST(sum(CASE WHEN value < 60 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct_so_far,
  round(CAST(sum(CASE WHEN value < 60 THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w, 4) AS accuracy_so_far,
  round(sum(round(value * 100)) OVER w / count(*) OVER w, 4) AS latency_so_far FROM events WINDOW w AS (ORDER BY event_id)""".replace("sum(1) OVER w", "count(*) OVER w"))
def running_progress(t: Tables) -> DataFrame:
    runs = t.events.select("event_id", "value", F.round(F.col("value") * 100).alias("cents"))
    return sampling.running_progress(runs, (F.col("value") < 60).cast("int"), "cents", [F.col("event_id")]).select(
        "event_id", "processed", "correct_so_far", "accuracy_so_far", "latency_so_far")


@query("batch_number", """SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 10 AS batch FROM events""")
def batch_number(t: Tables) -> DataFrame:
    return sampling.batch_number(t.events.select("event_id", "ts"), 10, [F.col("ts"), F.col("event_id")]).select("event_id", "batch")


@query("top_k_per_query", f"""WITH {roles.SQL_HITS} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 7""")
def top_k_per_query(t: Tables) -> DataFrame:
    return search.rank_by_score(roles.hits(t), "query_id", "score", "chunk_id", 7).select("query_id", "chunk_id", "score", "rank")


def _head_sql(n: int) -> str:
    return f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {n}"


@query("head_sample", _head_sql(150))
def head_sample(t: Tables) -> DataFrame:
    return sampling.head_sample(t.documents.select("doc_id", "text"), 150, ["doc_id"])


@query("seeded_shuffle", """SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position FROM documents""")
def seeded_shuffle(t: Tables) -> DataFrame:
    return sampling.seeded_shuffle(t.documents.select("doc_id", "lang"), "doc_id", 42)


@query("sample_to_target", """WITH n AS (SELECT count(*) AS n FROM documents), target AS (SELECT n * 5 // 3 AS want, n FROM n),
  o AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || want // n || ':' || doc_id), doc_id) AS place, want, n FROM documents, target)
SELECT doc_id, source, 0 AS draw FROM o UNION ALL SELECT doc_id, source, 1 FROM o WHERE place <= want % n""")
def sample_to_target(t: Tables) -> DataFrame:
    """Five thirds of the documents: each once, and two thirds of them again."""
    rows = t.documents.select("doc_id", "source")
    return sampling.sample_to_target(rows, rows.count() * 5 // 3, "doc_id", [])


# --- sets ---

@query("concat_datasets", """SELECT 0 AS part, doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents
UNION ALL SELECT 1, conv_id, text, NULL, role FROM conversations""")
def concat_datasets(t: Tables) -> DataFrame:
    return sampling.concat_datasets([
        t.documents.select(F.col("doc_id").alias("id"), "text", "lang"),
        t.conversations.select(F.col("conv_id").alias("id"), "text", "role")], "part")


@query("union_collections", f"""WITH {roles.SQL_HITS}
SELECT query_id, score, source, page_num, CAST(doc_id AS VARCHAR) AS doc_id, source AS text FROM hits
UNION ALL SELECT query_id, score, '[공지사항-' || event_type || '] ' || (user_id + 1), 1, CAST(chunk_id AS VARCHAR), props FROM hits JOIN events ON event_id = chunk_id""")
def union_collections(t: Tables) -> DataFrame:
    rules = roles.hits(t).select("query_id", "score", "source", "page_num", F.col("doc_id").cast("string").alias("doc_id"),
                                 F.col("source").alias("text"))
    notices = t.events.select(
        F.col("user_id").alias("query_id"), F.col("value").alias("score"), F.col("event_id").cast("string").alias("chunk_id"),
        (F.col("user_id") + 1).cast("string").alias("parent_id"), F.col("event_type").alias("category"), F.col("props").alias("chunk_text"))
    return search.union_collections([rules, search.notice_hits_to_common(notices).drop("chunk_id")])


# --- datasets ---

CUES = ("By the table, ", "From the image, ", " (see the figure)", " - as charted")


@query("balance_routes", f"""WITH {roles.SQL_LABELLED}, n AS (SELECT greatest(0, count(*) // 2 - count(*) FILTER (WHERE gold = 'VISION')) AS need FROM labelled),
  o AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY doc_id) AS pos, {sql_strip('question')} AS q, ({list(CUES)})[doc_id % 4 + 1] AS cue FROM labelled),
  c AS (SELECT *, gold = 'VISION' OR pos <= (SELECT need FROM n) AS conv FROM o)
SELECT doc_id, CASE WHEN NOT conv THEN question WHEN starts_with(cue, ' ') THEN CASE WHEN ends_with(q, '?') THEN left(q, -1) || cue || '?' ELSE q || cue END
  ELSE cue || q END AS question, CASE WHEN conv THEN 'VISION' ELSE 'TEXT' END AS route FROM c""")
def balance_routes(t: Tables) -> DataFrame:
    rows = roles.labelled_questions(t).select("doc_id", "question", F.lower("gold").alias("route"))
    return datasets.balance_routes(rows, question="question", route="route", order=[F.col("doc_id")],
                                   pick=F.col("doc_id"), cues=CUES)


@query("stratified_split", f"""WITH {roles.SQL_ROUTES}, o AS (SELECT doc_id, gold, row_number() OVER (PARTITION BY gold ORDER BY doc_id) AS p, count(*) OVER (PARTITION BY gold) AS n FROM routes)
SELECT doc_id, gold, CASE WHEN p <= floor(round(n * 0.8, 9)) THEN 'train' WHEN p <= floor(round(n * 0.8, 9)) + floor(round(n * 0.1, 9)) THEN 'val' ELSE 'test' END AS split FROM o""")
def stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(roles.routes(t).select("doc_id", "gold"), "gold", [F.col("doc_id")])


@query("stratified_split_seeded", f"""WITH {roles.SQL_ROUTES}, o AS (SELECT doc_id, gold, row_number() OVER (PARTITION BY gold ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY gold) AS n FROM routes)
SELECT doc_id, gold, CASE WHEN p <= floor(round(n * 0.8, 9)) THEN 'train' WHEN p <= floor(round(n * 0.8, 9)) + floor(round(n * 0.1, 9)) THEN 'val' ELSE 'test' END AS split FROM o""")
def stratified_split_seeded(t: Tables) -> DataFrame:
    return sampling.stratified_split(roles.routes(t).select("doc_id", "gold"), "gold",
                                     [sampling.shuffle_key("doc_id", 42), F.col("doc_id")])


@query("plain_split", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, count(*) OVER () AS n FROM labels)
SELECT doc_id, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM o""")
def plain_split(t: Tables) -> DataFrame:
    return sampling.plain_split(t.labels.select("doc_id"), [F.col("doc_id")])


@query("plain_split_two_stage", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, count(*) OVER () AS n FROM labels),
  h AS (SELECT *, CAST(ceil(round(n * 0.2, 9)) AS BIGINT) AS held FROM o)
SELECT doc_id, CASE WHEN p <= n - held THEN 'train' WHEN p <= n - ceil(held / 2) THEN 'val' ELSE 'test' END AS split FROM h""")
def plain_split_two_stage(t: Tables) -> DataFrame:
    return sampling.plain_split(t.labels.select("doc_id"), [F.col("doc_id")], two_stage=True)


@query("sft_rows", f"""WITH {roles.SQL_LABELLED} SELECT doc_id, 'Which mode?' AS instruction, '질문: ' || question AS "input", gold AS "output" FROM labelled""")
def sft_rows(t: Tables) -> DataFrame:
    rows = roles.labelled_questions(t)
    return rows.select("doc_id", *[c.alias(n) for n, c in datasets.sft_rows(
        F.col("question"), F.lower("gold"), instruction="Which mode?").items()])


@query("preference_pairs", f"""WITH {roles.SQL_LABELLED}
SELECT doc_id, question AS prompt, gold AS chosen, CASE gold WHEN 'TEXT' THEN 'VISION' ELSE 'TEXT' END AS rejected FROM labelled""")
def preference_pairs(t: Tables) -> DataFrame:
    return roles.labelled_questions(t).select("doc_id", *[
        c.alias(n) for n, c in datasets.preference_pairs(F.col("question"), F.col("gold")).items()])


@query("qa_seed_text", f"""WITH {roles.SQL_CHUNKS}
SELECT doc_id, string_agg('[' || chunk_no || '] ' || chunk, chr(10) || chr(10) ORDER BY chunk_no) AS seed FROM chunks GROUP BY 1""")
def qa_seed_text(t: Tables) -> DataFrame:
    from ..operators.chunking import paragraph_chunk_array

    rows = t.documents.select("doc_id", paragraph_chunk_array(F.col("text"), separator=roles.LINES).alias("chunks"))
    return rows.filter(F.size("chunks") > 0).select("doc_id", datasets.qa_seed_text(F.col("chunks")).alias("seed"))


@query("complete_testset", f"""WITH {roles.SQL_QA}, u AS (
  SELECT 0 AS part, qa_id AS o, question, answer AS ground_truth, ground_truth AS context_used FROM qa
  UNION ALL SELECT 1, doc_id, text, CASE WHEN lang = 'fr' THEN ' ' ELSE source END, lang FROM documents)
SELECT row_number() OVER (ORDER BY part, o) - 1 AS id, question, ground_truth, context_used FROM u
WHERE {sql_strip('question')} <> '' AND {sql_strip('ground_truth')} <> '' AND {sql_strip('context_used')} <> ''""")
def complete_testset(t: Tables) -> DataFrame:
    first = roles.qa(t).select(F.col("qa_id").alias("o"), "question", F.col("answer").alias("ground_truth"),
                               F.col("ground_truth").alias("context_used"))
    second = t.documents.select(F.col("doc_id").alias("o"), F.col("text").alias("question"),
                                F.when(F.col("lang") == "fr", " ").otherwise(F.col("source")).alias("ground_truth"),
                                F.col("lang").alias("context_used"))
    return datasets.complete_testset([first, second], "o")


@query("compare_dataset", f"""WITH {roles.SQL_HITS}, {roles.SQL_QA}
SELECT qa_id AS query_id, question, answer AS text_answer, ground_truth AS vision_answer,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT source)), ',') FROM ranked r WHERE r.rank <= 7 AND r.query_id * 1000 = qa.qa_id), '') AS sources FROM qa""")
def compare_dataset(t: Tables) -> DataFrame:
    pairs = roles.qa(t).withColumnRenamed("qa_id", "query_id")
    # User u asks the first question of conversation u.
    hits = roles.hits(t).withColumn("query_id", F.col("query_id") * 1000)
    best = search.rank_by_score(hits, "query_id", "score", "chunk_id", 7)
    answers = pairs.select("query_id", F.col("answer").alias("text_answer"), F.col("ground_truth").alias("vision_answer"))
    out = datasets.compare_dataset(pairs.select("query_id", "question"), answers, best)
    return out.select("query_id", "question", "text_answer", "vision_answer", F.array_join("retrieved_sources", ",").alias("sources"))

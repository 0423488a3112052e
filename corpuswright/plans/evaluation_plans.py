"""Routing, judging, retries, measures and comparison tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import routes as R
from ..operators import datasets, evaluation, lexical, reports, routing, sampling, search
from . import retrieval_plans as RP, roles
from .registry import Tables, query
from .roles import sql_tokens

CUES = ("the", "les", "der")
SQL_CUE = r"""regexp_matches({x}, '(?i)(^|[^\p{{L}}])(the|les|der)($|[^\p{{L}}])')"""


@query("route_by_cues", f"""SELECT conv_id, turn, CASE WHEN {SQL_CUE.format(x='text')} THEN 'VISION' ELSE 'TEXT' END AS route FROM conversations""")
def route_by_cues(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", R.route_by_cues(F.col("text"), CUES).alias("route"))


SQL_ROUTER = f"""WITH {roles.SQL_ROUTES}, texts AS (SELECT doc_id, list_distinct({sql_tokens('text')}) AS ts FROM documents),
lab AS (SELECT t.doc_id, ts, gold = 'VISION' AS v, md5('7:' || t.doc_id) < '4' AS held_out FROM texts t JOIN routes USING (doc_id)),
size AS (SELECT count(*) FILTER (v) AS nv, count(*) FILTER (NOT v) AS nt FROM lab WHERE NOT held_out),
tok AS (SELECT token, count(*) FILTER (v) AS v, count(*) FILTER (NOT v) AS t FROM (SELECT v, unnest(ts) AS token FROM lab WHERE NOT held_out) GROUP BY 1),
wt AS (SELECT token, CAST(round((ln((v + 1.0::DOUBLE) / (nv + 2.0::DOUBLE)) - ln((t + 1.0::DOUBLE) / (nt + 2.0::DOUBLE))) * 1000000) AS BIGINT) AS weight FROM tok, size WHERE v + t >= 2),
sums AS (SELECT doc_id, sum(weight) AS s FROM (SELECT doc_id, unnest(ts) AS token FROM texts) JOIN wt USING (token) GROUP BY 1),
scored AS (SELECT doc_id, CAST(round(1000000 * (ln(nv + 1.0::DOUBLE) - ln(nt + 1.0::DOUBLE))) + coalesce(s, 0) AS BIGINT) AS route_score FROM texts LEFT JOIN sums USING (doc_id), size)"""


def _router(t: Tables) -> tuple[DataFrame, routing.Router]:
    """Labelled documents with a quarter held out by MD5, and the router of the rest."""
    labelled = t.documents.select("doc_id", "text").join(roles.routes(t), "doc_id").withColumn(
        "held_out", sampling.shuffle_key("doc_id", 7) < "4")
    return labelled, routing.train_router(labelled.filter(~F.col("held_out")), "text", F.col("gold") == R.VISION, min_rows=2)


@query("route_classifier", f"""{SQL_ROUTER} SELECT doc_id, route_score, CASE WHEN route_score > 0 THEN 'VISION' ELSE 'TEXT' END AS route_pred FROM scored""")
def route_classifier(t: Tables) -> DataFrame:
    """Router trained on the documents' gold routes and applied to all documents."""
    _, model = _router(t)
    return routing.predicted_route(model, t.documents.select("doc_id", "text"), "doc_id", "text").drop("text")


@query("route_classifier_held_out", f"""{SQL_ROUTER} SELECT gold, count(*) AS n, count(*) FILTER ((route_score > 0) = (gold = 'VISION')) AS correct
FROM lab JOIN scored USING (doc_id) JOIN routes USING (doc_id) WHERE held_out GROUP BY 1""")
def route_classifier_held_out(t: Tables) -> DataFrame:
    """Hits per class on the documents the router has not seen."""
    labelled, model = _router(t)
    judged = routing.predicted_route(model, labelled.filter("held_out"), "doc_id", "text")
    return judged.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("route_pred") == F.col("gold"), 1)).alias("correct"))


@query("dispatch", f"""SELECT conv_id, turn, CASE WHEN {SQL_CUE.format(x='text')} THEN 'vision:' || role ELSE 'text:' || length(text) END AS answer FROM conversations""")
def dispatch(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("route", R.route_by_cues(F.col("text"), CUES))
    return routing.dispatch(
        rows, "route",
        lambda d: d.select("conv_id", "turn", F.concat(F.lit("text:"), F.length("text").cast("string")).alias("answer")),
        lambda d: d.select("conv_id", "turn", F.concat(F.lit("vision:"), F.col("role")).alias("answer")))


def sql_f1(a: str, b: str) -> str:
    """Multiset token F1 of two columns of ``qa``, as a table ``(qa_id, f1)``."""
    return f"""SELECT qa_id, round(coalesce(2.0::DOUBLE * common / nullif(n, 0), 0), 6) AS f1 FROM (
  SELECT qa_id, coalesce(sum(least(x, y)), 0) AS common, coalesce(sum(x), 0) + coalesce(sum(y), 0) AS n FROM (
    SELECT qa_id, tok, count(*) FILTER (WHERE side = 1) AS x, count(*) FILTER (WHERE side = 2) AS y FROM (
      SELECT qa_id, 1 AS side, unnest({sql_tokens(a)}) AS tok FROM qa UNION ALL SELECT qa_id, 2, unnest({sql_tokens(b)}) FROM qa) GROUP BY 1, 2) GROUP BY 1)"""


def sql_covered(wanted: str, present: str) -> str:
    return (f"round(coalesce(len(list_intersect(list_distinct({sql_tokens(wanted)}), list_distinct({sql_tokens(present)}))) "
            f"/ nullif(len(list_distinct({sql_tokens(wanted)})), 0), 0), 6)")


JOINED = "array_to_string(contexts, chr(10))"


@query("judge_route", f"""WITH {roles.SQL_QA}, a AS ({sql_f1('answer', 'ground_truth')}), b AS ({sql_f1('question', 'ground_truth')})
SELECT qa_id, CASE WHEN a.f1 >= 0.2 THEN 'TEXT' WHEN b.f1 >= 0.1 + 0.1 THEN 'VISION' ELSE 'REJECT' END AS route FROM qa LEFT JOIN a USING (qa_id) LEFT JOIN b USING (qa_id)""")
def judge_route(t: Tables) -> DataFrame:
    route = routing.judge_route(F.col("answer"), F.col("question"), F.col("ground_truth"), 0.2)
    return roles.qa(t).select("qa_id", route.alias("route"))


@query("critic_score", f"""WITH {roles.SQL_QA}, s AS (SELECT qa_id, question, CASE turn WHEN 1 THEN ' ' WHEN 3 THEN '정답 없음' ELSE answer END AS answer FROM qa)
SELECT qa_id, CASE WHEN trim(answer) IN ('', '정답 없음') OR {sql_covered('question', 'answer')} < 0.3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM s""")
def critic_score(t: Tables) -> DataFrame:
    answer = F.when(F.col("turn") == 1, " ").when(F.col("turn") == 3, "정답 없음").otherwise(F.col("answer"))
    return roles.qa(t).select("qa_id", routing.critic_score(F.col("question"), answer, 0.3).alias("score"))


@query("read_score", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.5::DOUBLE ELSE value END AS score FROM events""")
def read_score(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", "about 1").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\n")))
    return t.events.select("event_id", routing.read_score(raw).alias("score"))


def _answer_pass(t: Tables, asked: DataFrame, k: int, profile: lexical.Profile) -> DataFrame:
    """Route, search ``k`` documents, answer with their texts, score the answer."""
    asked = asked.withColumn("route", R.route_by_cues(F.col("question"), CUES))
    hits = lexical.lexical_topk(RP.docs(t), "chunk_id", "text", asked, "query_id", "question", k,
                                drop_build=RP.RATIO, profile=profile)
    texts = search.with_texts(hits, RP.docs(t), asked, k)
    answers = search.format_hits(texts, lambda i, h: h["text"], "\n", ["text"], out="answer")
    found = asked.join(answers, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return found.withColumn("score", routing.critic_score(F.col("question"), F.col("answer"), 0.9))


@query("bounded_retry", f"""{RP.SQL_DOC_SPARSE}, a AS (
  SELECT query_id, question, coalesce(string_agg(d.text, chr(10) ORDER BY rank) FILTER (WHERE rank <= 1), '') AS one, coalesce(string_agg(d.text, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3), '') AS three
  FROM asked_text LEFT JOIN (SELECT * FROM sparse WHERE rank <= 3) USING (query_id) LEFT JOIN docs d USING (chunk_id) GROUP BY 1, 2),
  s AS (SELECT *, CASE WHEN {sql_covered('question', 'one')} < 0.9 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS s1, CASE WHEN {sql_covered('question', 'three')} < 0.9 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS s2 FROM a)
SELECT query_id, CASE WHEN s1 >= 0.8 THEN one ELSE three END AS answer, CASE WHEN s1 >= 0.8 THEN s1 ELSE s2 END AS score,
  CAST(CASE WHEN s1 >= 0.8 THEN 1 ELSE 2 END AS BIGINT) AS retry_count, CASE WHEN {SQL_CUE.format(x='question')} THEN 'VISION' ELSE 'TEXT' END AS route FROM s""")
def bounded_retry(t: Tables) -> DataFrame:
    profile = lexical.question_profile(RP.docs(t), "text", roles.questions(t), "query_id", "question", RP.RATIO)
    done = routing.bounded_retry(roles.questions(t), lambda asked, n: _answer_pass(t, asked, 1 if n == 1 else 3, profile))
    return done.select("query_id", "answer", "score", "retry_count", "route")


SQL_BENCH = f"""WITH {RP.SQL_DOCS}, first AS (SELECT item_id AS o, text AS question, '' AS ground_truth FROM benchmark),
second AS (SELECT conv_id * 1000 + turn AS o, text AS question, role AS ground_truth FROM conversations),
alls AS (SELECT 0 AS part, * FROM first UNION ALL SELECT 1, * FROM second),
asked_text AS (SELECT (part || ':' || o) AS query_id, question, ground_truth FROM alls), {RP.sql_weights('docs')},
a AS (SELECT query_id, any_value(question) AS question, any_value(ground_truth) AS ground_truth, coalesce(string_agg(d.source, ',' ORDER BY rank), '') AS contexts, coalesce(min_by(d.lang, rank), '') AS answer
  FROM asked_text LEFT JOIN (SELECT * FROM sparse WHERE rank <= 3) USING (query_id) LEFT JOIN docs d USING (chunk_id) GROUP BY 1)
SELECT * FROM a"""


@query("agent_benchmark", SQL_BENCH)
def agent_benchmark(t: Tables) -> DataFrame:
    """Both question sets, whole, through route, search and answer."""
    first = t.benchmark.select(F.col("item_id").alias("o"), F.col("text").alias("query"))
    second = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), F.col("text").alias("question"),
                                    F.col("role").alias("answer"))

    def run(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("query_id", F.concat_ws(":", F.col("part").cast("string"), F.col("query_id").cast("string")))
        hits = lexical.lexical_topk(RP.docs(t), "chunk_id", "text", asked, "query_id", "question", 3,
                                    drop_build=RP.RATIO, drop_search=RP.RATIO)
        rows = search.attach(hits, RP.docs(t), search.measure(asked.select("query_id")).rows * 3)
        found = rows.groupBy("query_id").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda h: h["source"]), ",").alias("contexts"),
            F.min_by("lang", "rank").alias("answer"))
        return (asked.join(found, "query_id", "left").na.fill("", ["contexts", "answer"])
                .select("query_id", "question", "ground_truth", "answer", "contexts"))

    return routing.agent_benchmark([first, second], None, "o", run)


def _wide(t: Tables) -> DataFrame:
    c = F.col
    rows = roles.qa(t).select(
        "qa_id", "question", "ground_truth", R.route_by_cues(c("question"), CUES).alias("route_pred"),
        c("answer").alias("text_answer"), c("ground_truth").alias("vision_answer"),
        c("contexts").alias("text_contexts"), F.array("question").alias("vision_contexts"),
        F.length("question").cast("double").alias("text_latency"), F.length("answer").cast("double").alias("vision_latency"))
    return routing.three_way_wide(rows)


@query("three_way_benchmark", f"""WITH {roles.SQL_QA}, w AS (SELECT qa_id, CASE WHEN {SQL_CUE.format(x='question')} THEN 'VISION' ELSE 'TEXT' END AS route_pred, answer AS ta, ground_truth AS va,
  array_to_string(contexts, '|') AS tc, question AS vc, length(question)::DOUBLE AS tl, length(answer)::DOUBLE AS vl FROM qa)
SELECT qa_id, route_pred, 'always_text' AS pipeline, ta AS answer, tc AS contexts, tl AS latency FROM w
UNION ALL SELECT qa_id, route_pred, 'always_vision', va, vc, vl FROM w
UNION ALL SELECT qa_id, route_pred, 'routed', CASE route_pred WHEN 'TEXT' THEN ta ELSE va END, CASE route_pred WHEN 'TEXT' THEN tc ELSE vc END, CASE route_pred WHEN 'TEXT' THEN tl ELSE vl END FROM w""")
def three_way_benchmark(t: Tables) -> DataFrame:
    long = routing.three_way_long(_wide(t), ["qa_id", "route_pred"])
    return long.withColumn("contexts", F.array_join("contexts", "|"))


# --- measures ---

@query("token_f1", f"""WITH {roles.SQL_QA}, f AS ({sql_f1('answer', 'ground_truth')}) SELECT qa_id, coalesce(f1, 0) AS token_f1 FROM qa LEFT JOIN f USING (qa_id)""")
def token_f1(t: Tables) -> DataFrame:
    return evaluation.with_measures(roles.qa(t), ("token_f1",)).select("qa_id", "token_f1")


@query("answer_support", f"""WITH {roles.SQL_QA} SELECT qa_id, {sql_covered('answer', JOINED)} AS answer_support FROM qa""")
def answer_support(t: Tables) -> DataFrame:
    return evaluation.with_measures(roles.qa(t), ("answer_support",)).select("qa_id", "answer_support")


@query("context_recall_lex", f"""WITH {roles.SQL_QA} SELECT qa_id, {sql_covered('ground_truth', JOINED)} AS context_recall_lex FROM qa""")
def context_recall_lex(t: Tables) -> DataFrame:
    return evaluation.with_measures(roles.qa(t), ("context_recall_lex",)).select("qa_id", "context_recall_lex")


SQL_AP = f"""{roles.SQL_QA}, c AS (SELECT qa_id, list_distinct({sql_tokens('question')}) AS w, unnest(contexts) AS ctx, unnest(range(1, len(contexts) + 1)) AS i FROM qa),
rel AS (SELECT qa_id, i, CASE WHEN coalesce(len(list_intersect(w, list_distinct({sql_tokens('ctx')}))) / nullif(len(w), 0), 0) >= 0.5 THEN 1 ELSE 0 END AS r FROM c),
pre AS (SELECT qa_id, r, sum(r) OVER (PARTITION BY qa_id ORDER BY i)::DOUBLE / i AS p FROM rel),
ap AS (SELECT qa_id, round(coalesce(sum(p * r) / nullif(sum(r), 0), 0), 6) AS context_ap FROM pre GROUP BY 1)"""


@query("context_ap", f"""WITH {SQL_AP} SELECT qa_id, coalesce(context_ap, 0) AS context_ap FROM qa LEFT JOIN ap USING (qa_id)""")
def context_ap(t: Tables) -> DataFrame:
    rows = roles.qa(t).withColumn("ground_truth", F.col("question"))
    return evaluation.with_measures(rows, ("context_ap",)).select("qa_id", "context_ap")


SQL_COSINE = f"""tq AS (SELECT qa_id, tok, count(*) AS c FROM (SELECT qa_id, unnest({sql_tokens('question')}) AS tok FROM qa) GROUP BY 1, 2),
ta AS (SELECT qa_id, tok, count(*) AS c FROM (SELECT qa_id, unnest({sql_tokens('answer')}) AS tok FROM qa) GROUP BY 1, 2),
nq AS (SELECT qa_id, sqrt(sum(c * c)) AS n FROM tq GROUP BY 1), na AS (SELECT qa_id, sqrt(sum(c * c)) AS n FROM ta GROUP BY 1),
dots AS (SELECT qa_id, sum(tq.c * ta.c) AS d FROM tq JOIN ta USING (qa_id, tok) GROUP BY 1)"""


@query("question_answer_cosine", f"""WITH {roles.SQL_QA}, {SQL_COSINE}
SELECT qa_id, round(coalesce(d / (nq.n * na.n), 0), 6) AS question_answer_cosine FROM qa LEFT JOIN dots USING (qa_id) LEFT JOIN nq USING (qa_id) LEFT JOIN na USING (qa_id)""")
def question_answer_cosine(t: Tables) -> DataFrame:
    return evaluation.with_measures(roles.qa(t), ("question_answer_cosine",)).select("qa_id", "question_answer_cosine")


@query("reverse_eval", f"""WITH {roles.SQL_QA}, a AS ({sql_f1('answer', 'ground_truth')}), b AS ({sql_f1('question', 'ground_truth')})
SELECT qa_id, 'text_answer' AS dataset, coalesce(f1, 0) AS token_f1, {sql_covered('answer', JOINED)} AS answer_support, {sql_covered('ground_truth', JOINED)} AS context_recall_lex FROM qa LEFT JOIN a USING (qa_id)
UNION ALL SELECT qa_id, 'original_truth', coalesce(f1, 0), {sql_covered('question', JOINED)}, {sql_covered('ground_truth', JOINED)} FROM qa LEFT JOIN b USING (qa_id)""")
def reverse_eval(t: Tables) -> DataFrame:
    pairs = roles.qa(t)
    vision = pairs.select("qa_id", F.col("ground_truth").alias("answer"))
    text = pairs.select("qa_id", "question", "answer", "contexts", F.col("question").alias("ground_truth"))
    return evaluation.reverse_eval(vision, text, "qa_id").select(
        "qa_id", "dataset", "token_f1", "answer_support", "context_recall_lex")


@query("comparison_table", f"""WITH {roles.SQL_QA}, w AS (SELECT qa_id, question, ground_truth, contexts, CASE WHEN {SQL_CUE.format(x='question')} THEN 'VISION' ELSE 'TEXT' END AS route, conv_id, answer AS ta, ground_truth AS va, length(question)::DOUBLE AS tl, length(answer)::DOUBLE AS vl FROM qa),
l AS (SELECT qa_id, question, contexts, 'always_text' AS pipeline, ta AS answer, tl AS latency FROM w UNION ALL SELECT qa_id, question, [question], 'always_vision', va, vl FROM w
  UNION ALL SELECT qa_id, question, CASE route WHEN 'TEXT' THEN contexts ELSE [question] END, 'routed', CASE route WHEN 'TEXT' THEN ta ELSE va END, CASE route WHEN 'TEXT' THEN tl ELSE vl END FROM w),
m AS (SELECT pipeline, round(avg({sql_covered('answer', JOINED)}), 6) AS s, avg(latency) AS lat FROM l GROUP BY 1),
acc AS (SELECT avg(CASE WHEN route = CASE conv_id % 2 WHEN 0 THEN 'TEXT' ELSE 'VISION' END THEN 1.0::DOUBLE ELSE 0 END) AS a FROM w)
SELECT pipeline, CASE pipeline WHEN 'routed' THEN printf('%.1f', (SELECT a FROM acc) * 100) || '%' ELSE '-' END AS routing_accuracy,
  printf('%.3f', s) AS answer_support, printf('%.2f', lat) AS latency FROM m""")
def comparison_table(t: Tables) -> DataFrame:
    wide = _wide(t)
    long = routing.three_way_long(wide, ["qa_id", "question", "ground_truth", "route_pred"])
    scored = evaluation.with_measures(long, ("answer_support",))
    gold = F.when(F.floor(F.col("qa_id") / 1000) % 2 == 0, R.TEXT).otherwise(R.VISION)
    accuracy = long.groupBy("pipeline").agg(F.avg((gold == F.col("route_pred")).cast("double")).alias("route_accuracy"))
    return reports.comparison_table(
        reports.metric_means(scored, ["answer_support"], ["pipeline"]),
        scored.groupBy("pipeline").agg(F.avg("latency").alias("latency")), accuracy, ["answer_support"], routed="routed")


@query("router_experiment", f"""WITH {roles.SQL_LABELLED}, v AS (SELECT * FROM labelled WHERE length(question) > 5),
  n AS (SELECT greatest(0, count(*) // 2 - count(*) FILTER (WHERE gold = 'VISION')) AS need FROM v),
  o AS (SELECT doc_id, gold, row_number() OVER (PARTITION BY gold ORDER BY doc_id) AS pos FROM v),
  b AS (SELECT doc_id, CASE WHEN gold = 'VISION' OR pos <= (SELECT need FROM n) THEN 'VISION' ELSE 'TEXT' END AS route FROM o),
  p AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY doc_id) AS p, count(*) OVER (PARTITION BY route) AS c FROM b)
SELECT CASE WHEN p <= floor(round(c * 0.8, 9)) THEN 'train' WHEN p <= floor(round(c * 0.8, 9)) + floor(round(c * 0.1, 9)) THEN 'val' ELSE 'test' END AS split, route, count(*) AS rows FROM p GROUP BY 1, 2""")
def router_experiment(t: Tables) -> DataFrame:
    """Verify, balance, split: the label counts of the router's datasets."""
    from ..operators.filters import verified
    from ..operators.sampling import stratified_split

    rows = roles.labelled_questions(t).select("doc_id", "question", F.col("gold").alias("route"))
    kept = rows.filter(verified(F.col("question"), [F.col("route")]))
    balanced = datasets.balance_routes(kept, question="question", route="route", order=[F.col("doc_id")], pick=F.col("doc_id"),
                                       cues=("By the table, ", " (see the figure)"))
    return reports.label_counts(stratified_split(balanced, "route", [F.col("doc_id")]), "split", "route")

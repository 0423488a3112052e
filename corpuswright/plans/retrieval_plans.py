"""Sparse, dense, fused, reranked and staged search over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import contexts as C
from ..operators import dense, lexical, quantised, search
from ..operators.chunking import notice_chunks
from ..session import materialise, spread
from ..sources.html import visible_text
from . import roles
from .registry import Tables, query
from .roles import sql_norm, sql_tokens


def sql_weights(corpus: str, name: str = "", drop: float = fixed.SPARSE_DROP_RATIO) -> str:
    """Document and question weights over ``corpus(chunk_id, text)`` and ``asked_text(query_id, question)``."""
    n = name
    return f"""
{n}toks AS (SELECT chunk_id, {sql_tokens('text')} AS ts FROM {corpus}),
{n}stats AS (SELECT count(*) AS docs, avg(len(ts)) AS mean FROM {n}toks),
{n}tf AS (SELECT chunk_id, tok, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS tok FROM {n}toks) GROUP BY 1, 2),
{n}len AS (SELECT chunk_id, sum(tf) AS dl, count(*) AS terms FROM {n}tf GROUP BY 1),
{n}wd AS (SELECT chunk_id, tok, terms, tf * 2.2::DOUBLE / (tf + (0.3::DOUBLE + 0.9::DOUBLE / mean * dl)) AS weight
  FROM {n}tf JOIN {n}len USING (chunk_id), {n}stats),
{n}wdp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight, tok) AS place FROM {n}wd) WHERE place > floor(terms * {drop}::DOUBLE)),
{n}df AS (SELECT tok, count(*) AS df FROM {n}tf GROUP BY 1),
{n}qtf AS (SELECT query_id, tok, count(*) AS tf FROM (SELECT query_id, unnest({sql_tokens('question')}) AS tok FROM asked_text) GROUP BY 1, 2),
{n}wq AS (SELECT query_id, tok, round(tf * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS weight, count(*) OVER (PARTITION BY query_id) AS terms
  FROM {n}qtf JOIN {n}df USING (tok), {n}stats),
{n}wqp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight, tok) AS place FROM {n}wq) WHERE place > floor(terms * {drop}::DOUBLE)),
{n}scores AS (SELECT q.query_id, d.chunk_id, round(sum(d.weight * q.weight), 6) AS score FROM {n}wdp d JOIN {n}wqp q USING (tok) GROUP BY 1, 2),
{n}sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {n}scores)"""


SQL_ASKED = "asked_text AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
SQL_DOCS = "docs AS (SELECT doc_id AS chunk_id, text, lang, source FROM documents)"
SQL_CHUNK_SPARSE = f"WITH {roles.SQL_CHUNKS}, {SQL_ASKED}, corpus AS (SELECT chunk_id, chunk_text AS text FROM notice_chunks), {sql_weights('corpus')}"
SQL_DOC_SPARSE = f"WITH {SQL_DOCS}, {SQL_ASKED}, {sql_weights('docs')}"


def docs(t: Tables) -> DataFrame:
    return spread(t.documents, "doc_id").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def doc_vectors(t: Tables) -> DataFrame:
    """Vectors of the documents that have one."""
    known = t.documents.select(F.col("doc_id").alias("chunk_id"))
    return roles.vectors(t).drop("cell").join(known, "chunk_id", "left_semi")


def chunks(t: Tables) -> DataFrame:
    return notice_chunks(roles.notices(t), separator=roles.LINES)


RATIO = fixed.SPARSE_DROP_RATIO


def chunk_hits(t: Tables, k: int) -> DataFrame:
    corpus = chunks(t).select("chunk_id", F.col("chunk_text").alias("text"))
    return lexical.lexical_topk(corpus, "chunk_id", "text", roles.questions(t), "query_id", "question", k,
                                drop_build=RATIO, drop_search=RATIO)


def doc_hits(t: Tables, k: int) -> DataFrame:
    return lexical.lexical_topk(docs(t), "chunk_id", "text", roles.questions(t), "query_id", "question", k,
                                drop_build=RATIO, drop_search=RATIO)


@query("lexical_weights", f"""WITH {SQL_DOCS}, {SQL_ASKED}, {sql_weights('docs')} SELECT chunk_id, tok AS token, round(weight, 6) AS weight FROM wd""")
def lexical_weights(t: Tables) -> DataFrame:
    vector = lexical.lexical_weights("text", lexical.corpus_stats(docs(t), "text"))
    return _rounded(lexical.postings_of(docs(t), "chunk_id", vector))


def _rounded(postings: DataFrame) -> DataFrame:
    return postings.withColumn("weight", F.round("weight", 6))


@query("prune_small_weights", f"""WITH {SQL_DOCS}, {SQL_ASKED}, {sql_weights('docs')} SELECT chunk_id, tok AS token, round(weight, 6) AS weight FROM wdp""")
def prune_small_weights(t: Tables) -> DataFrame:
    vector = lexical.lexical_weights("text", lexical.corpus_stats(docs(t), "text"))
    return _rounded(lexical.postings_of(docs(t), "chunk_id", lexical.prune_small_weights(vector, RATIO)))


@query("query_weights", f"""{SQL_DOC_SPARSE} SELECT query_id, tok AS token, weight FROM wqp""")
def query_weights(t: Tables) -> DataFrame:
    return lexical.question_profile(docs(t), "text", roles.questions(t), "query_id", "question", RATIO).asked


@query("sparse_topk", f"{SQL_CHUNK_SPARSE} SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 10")
def sparse_topk(t: Tables) -> DataFrame:
    return chunk_hits(t, 10)


@query("passage_contexts", f"""{SQL_CHUNK_SPARSE}, hit AS (SELECT s.query_id, s.rank, c.parent_id, c.category, c.chunk_text FROM sparse s JOIN notice_chunks c USING (chunk_id) WHERE rank <= 10)
SELECT query_id, string_agg(chr(10) || '### 문서 조각 ' || rank || ' [출처: [공지-' || category || '] ' || parent_id || '] ###' || chr(10) || chunk_text || chr(10), '' ORDER BY rank) AS context,
  count(*) AS hits FROM hit GROUP BY 1""")
def passage_contexts(t: Tables) -> DataFrame:
    """Per benchmark passage, its ten best document chunks as one context."""
    asked = roles.questions(t)
    hits = chunk_hits(t, 10)
    rows = search.attach(hits, chunks(t).select("chunk_id", "parent_id", "category", "chunk_text"),
                         search.measure(asked).rows * 10)
    common = search.notice_hits_to_common(rows, layout=fixed.NODE_SOURCE_LAYOUT, empty_is_missing=True)
    formatted = search.format_hits(common, lambda i, h: C.block_node(i, h["source"], h["text"]),
                                   C.LAYOUT_SEPARATORS["node"], ["source", "text"])
    return formatted.join(common.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits")), "query_id")


@query("dense_topk", f"""WITH {roles.SQL_VECTORS}, s AS (SELECT a.query_id, d.chunk_id, round(list_inner_product(a.v, d.v), 6) AS score FROM asked a, vecs d)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(t: Tables) -> DataFrame:
    return dense.dense_topk(roles.vectors(t), roles.question_vectors(t), 10)


SQL_CENTROIDS = """parts AS (SELECT cell, unnest(v) AS x, unnest(range(1, 65)) AS i FROM vecs),
means AS (SELECT cell, i, avg(x) AS x FROM parts GROUP BY 1, 2),
centroids AS (SELECT cell, list(x ORDER BY i) AS v FROM means GROUP BY 1)"""


@query("ivf_topk", f"""WITH {roles.SQL_VECTORS}, {SQL_CENTROIDS},
  near AS (SELECT a.query_id, a.v, c.cell, row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_inner_product(a.v, c.v), 6) DESC, c.cell) AS place FROM asked a, centroids c),
  s AS (SELECT n.query_id, d.chunk_id, round(list_inner_product(n.v, d.v), 6) AS score FROM near n JOIN vecs d USING (cell) WHERE place <= 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def ivf_topk(t: Tables) -> DataFrame:
    centroids = dense.mean_vectors(roles.vectors(t), "cell", "vector", 64)
    return dense.ivf_topk(roles.vectors(t), roles.question_vectors(t), centroids, 10, nprobe=3)


@query("ivf_trained_all_cells", f"""WITH {roles.SQL_VECTORS}, s AS (SELECT a.query_id, d.chunk_id, round(list_inner_product(a.v, d.v), 6) AS score FROM asked a, vecs d)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def ivf_trained_all_cells(t: Tables) -> DataFrame:
    """With all trained cells probed the search is the exact one."""
    placed, centroids = dense.train_cells(roles.vectors(t).drop("cell"), "vector", cells=16)
    return dense.ivf_topk(placed, roles.question_vectors(t), centroids, 10, nprobe=16)


@query("ivf_trained")
def ivf_trained(t: Tables) -> DataFrame:
    """Cells from k-means instead of the given labels."""
    placed, centroids = dense.train_cells(roles.vectors(t).drop("cell"), "vector", cells=16)
    return dense.ivf_topk(placed, roles.question_vectors(t), centroids, 10, nprobe=4)


def _coded(t: Tables):
    words = quantised.train_codewords(roles.vectors(t))
    return materialise(quantised.with_codes(spread(roles.vectors(t), "chunk_id").drop("cell"), words), "codes"), words


@query("quantised_topk")
def quantised_topk(t: Tables) -> DataFrame:
    coded, words = _coded(t)
    return quantised.quantised_topk(coded, roles.question_vectors(t), words, 10)


@query("quantised_recall", f"""WITH {roles.SQL_VECTORS} SELECT (SELECT count(*) FROM asked) * least(10, (SELECT count(*) FROM vecs)) AS wanted, TRUE AS enough""")
def quantised_recall(t: Tables) -> DataFrame:
    """At least 95 of 100 exact hits are found by codes of a sixteenth of the vectors' size."""
    exact = dense.dense_topk(roles.vectors(t), roles.question_vectors(t), 10)
    measured = quantised.recall(quantised_topk(t), exact)
    return measured.select("wanted", (F.col("recall") >= 0.95).alias("enough"))


@query("progressive_search", f"""WITH {roles.SQL_VECTORS},
  s0 AS (SELECT a.query_id, d.chunk_id, a.v AS q, d.v AS d, round(list_inner_product(a.v, d.v), 6) AS score FROM asked a, vecs d),
  r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s0),
  s1 AS (SELECT *, round(list_distance(q[1:32], d[1:32]), 6) AS d1 FROM r0 WHERE r <= 100),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d1, chunk_id) AS p1 FROM s1),
  s2 AS (SELECT query_id, chunk_id, round(list_distance(q, d), 6) AS distance FROM r1 WHERE p1 <= 50)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM s2) WHERE rank <= 10""")
def progressive_search(t: Tables) -> DataFrame:
    return dense.progressive_search(roles.vectors(t), roles.question_vectors(t), [(32, 50), (64, 10)])


SQL_HYBRID = f"""{SQL_DOC_SPARSE}, {roles.SQL_VECTORS},
dense_scores AS (SELECT a.query_id, d.chunk_id, round(list_inner_product(a.v, d.v), 6) AS score FROM asked a, vecs d WHERE d.chunk_id IN (SELECT chunk_id FROM docs)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_scores),
votes AS (SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 50),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM votes GROUP BY 1, 2),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 50),
cand AS (SELECT f.query_id, f.chunk_id, f.score, d.text, d.lang, d.source, list_distinct({sql_tokens('question')}) AS qs, list_distinct({sql_tokens('d.text')}) AS ps
  FROM rrf f JOIN docs d USING (chunk_id) JOIN asked_text USING (query_id)),
judged AS (SELECT *, round(coalesce(len(list_intersect(qs, ps)) / nullif(len(qs), 0), 0), 6) AS rerank_score FROM cand),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, chunk_id) AS rank FROM judged)"""


@query("rrf", f"{SQL_HYBRID} SELECT query_id, chunk_id, score, rank FROM rrf")
def rrf(t: Tables) -> DataFrame:
    return search.hybrid_candidates(docs(t), roles.questions(t), doc_vectors(t), roles.question_vectors(t), 50)


def hybrid(t: Tables, preset: str = "notice") -> DataFrame:
    return search.preset_search(preset, docs(t), roles.questions(t), vectors=doc_vectors(t),
                                question_vectors=roles.question_vectors(t))


@query("hybrid_search", f"{SQL_HYBRID} SELECT query_id, chunk_id, score, rerank_score, rank FROM hybrid WHERE rank <= 10")
def hybrid_search(t: Tables) -> DataFrame:
    return hybrid(t).select("query_id", "chunk_id", "score", "rerank_score", "rank")


@query("hybrid_search_vision_node", f"{SQL_HYBRID} SELECT query_id, chunk_id, rerank_score, rank FROM hybrid WHERE rank <= 25")
def hybrid_search_vision_node(t: Tables) -> DataFrame:
    return hybrid(t, "vision_node").select("query_id", "chunk_id", "rerank_score", "rank")


@query("rerank", f"""{SQL_DOC_SPARSE}, cand AS (SELECT s.query_id, s.chunk_id, s.score, list_distinct({sql_tokens('question')}) AS qs, list_distinct({sql_tokens('d.text')}) AS ps
    FROM sparse s JOIN docs d USING (chunk_id) JOIN asked_text USING (query_id) WHERE rank <= 15),
  j AS (SELECT *, round(1 / (1 + exp(-round(coalesce(len(list_intersect(qs, ps)) / nullif(len(qs), 0), 0), 6))), 6) AS rerank_score FROM cand)
SELECT * FROM (SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, chunk_id) AS rank FROM j) WHERE rank <= 3""")
def rerank(t: Tables) -> DataFrame:
    rows = search.with_texts(doc_hits(t, 15), docs(t), roles.questions(t), 15)
    return search.rerank(rows, 3, normalise=True).select("query_id", "chunk_id", "rerank_score", "rank")


SQL_VISIBLE = ("regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->', ' ', 'g')")
SQL_VISIBLE = f"regexp_replace({SQL_VISIBLE}, '(?s)<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    SQL_VISIBLE = f"replace({SQL_VISIBLE}, '{_entity}', {_char})"
SQL_VISIBLE = sql_norm(SQL_VISIBLE)


def _sql_collection(name: str, corpus: str) -> str:
    return f"""{sql_weights(corpus, name)},
{name}dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.query_id, d.chunk_id, round(list_inner_product(a.v, d.v), 6) AS score FROM asked a, vecs d WHERE d.chunk_id IN (SELECT chunk_id FROM {corpus}))),
{name}fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (
  SELECT query_id, chunk_id, rank FROM {name}sparse WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, rank FROM {name}dense WHERE rank <= 10) GROUP BY 1, 2),
{name}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM {name}fused) WHERE r <= 10)"""


@query("multi_collection_search", f"""WITH {SQL_DOCS}, {SQL_ASKED}, {roles.SQL_VECTORS},
web AS (SELECT page_id AS chunk_id, {SQL_VISIBLE} AS text, url AS source FROM pages),
{_sql_collection('n_', 'docs')}, {_sql_collection('r_', 'web')},
alls AS (SELECT query_id, 'notices' AS collection, 'notices:' || chunk_id AS chunk_id, '[공지사항-' || lang || '] ' || d.source AS source, text, score FROM n_best JOIN docs d USING (chunk_id)
  UNION ALL SELECT query_id, 'rules', 'rules:' || chunk_id, w.source, text, score FROM r_best JOIN web w USING (chunk_id)),
j AS (SELECT a.*, list_distinct({sql_tokens('question')}) AS qs, list_distinct({sql_tokens('a.text')}) AS ps FROM alls a JOIN asked_text USING (query_id)),
s AS (SELECT *, round(1 / (1 + exp(-round(coalesce(len(list_intersect(qs, ps)) / nullif(len(qs), 0), 0), 6))), 6) AS rerank_score FROM j)
SELECT query_id, collection, chunk_id, source, rerank_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def multi_collection_search(t: Tables) -> DataFrame:
    # The page texts are extracted once into a table that every pass reads.
    web = materialise(spread(t.pages, "page_id").select(
        F.col("page_id").alias("chunk_id"), visible_text(F.col("html")).alias("text"),
        F.col("url").alias("source"), F.lit(1).alias("page_num")), "web")
    label = C.source_label(F.col("lang"), F.col("source"), fixed.MERGED_SOURCE_LAYOUT, empty_is_missing=False)
    board = docs(t).select("chunk_id", "text", label.alias("source"), F.lit(1).alias("page_num"))
    retrieve_k, final_k = fixed.SEARCH_PRESETS["multi"]
    vectors = roles.vectors(t).drop("cell")
    found = search.multi_collection_search({
        "notices": {"chunks": board, "vectors": doc_vectors(t)},
        "rules": {"chunks": web, "vectors": vectors.join(web.select("chunk_id"), "chunk_id", "left_semi")},
    }, roles.questions(t), roles.question_vectors(t), retrieve_k=retrieve_k, final_k=final_k)
    return found.select("query_id", "collection", "chunk_id", "source", "rerank_score", "rank")


@query("preview_hits", f"""{SQL_HYBRID} SELECT query_id, chunk_id, lang, rank, substring(replace(text, chr(10), ' '), 1, 150) AS preview FROM hybrid WHERE rank <= 3""")
def preview_hits(t: Tables) -> DataFrame:
    return search.preview_hits(hybrid(t)).select("query_id", "chunk_id", "lang", "rank", "preview")


@query("retrieval_hit_rate", f"""{SQL_DOC_SPARSE}, h AS (SELECT query_id, max(CASE WHEN contains(d.text, question) THEN 1 ELSE 0 END) AS hit
    FROM sparse JOIN docs d USING (chunk_id) JOIN asked_text USING (query_id) WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS questions, CAST(sum(coalesce(hit, 0)) AS BIGINT) AS found, round(avg(coalesce(hit, 0)::DOUBLE), 6) AS hit_rate FROM asked_text LEFT JOIN h USING (query_id)""")
def retrieval_hit_rate(t: Tables) -> DataFrame:
    rows = search.with_texts(doc_hits(t, 10), docs(t), roles.questions(t), 10)
    return search.retrieval_hit_rate(rows, roles.questions(t))


def _top3(t: Tables) -> DataFrame:
    hits = doc_hits(t, 3)
    rows = search.attach(hits, docs(t), search.measure(roles.questions(t)).rows * 3)
    return rows.withColumn("page_num", F.col("chunk_id") % 9)


SQL_TOP3 = f"{SQL_DOC_SPARSE}, top3 AS (SELECT s.query_id, s.rank, chunk_id % 9 AS page, d.*, count(*) OVER (PARTITION BY query_id) AS n FROM sparse s JOIN docs d USING (chunk_id) WHERE rank <= 3)"


SQL_RULE = "chr(10) || chr(10) || repeat('=', 40)"


@query("format_context", f"""{SQL_TOP3}
SELECT query_id,
  string_agg('[참고 문서 ' || rank || ']' || chr(10) || '- 출처: ' || source || ' (페이지: ' || page || ')' || chr(10) || '- 내용: ' || text || chr(10) || chr(10), '' ORDER BY rank) AS merged,
  {SQL_RULE} || string_agg('[문서 중요도 순위: ' || rank || '위]' || chr(10) || '- 작성연도: 2024년' || chr(10) || '- 담당부서: ' || source || chr(10) || '- 분류: ' || lang || chr(10) || '- 본문 내용:' || chr(10) || text, chr(10) || chr(10) ORDER BY rank DESC) || {SQL_RULE} AS ranked,
  string_agg('[문서 출처: 2024년 ' || source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank DESC) AS year,
  string_agg(chr(10) || '### 문서 조각 ' || rank || ' [출처: ' || source || '] ###' || chr(10) || text || chr(10), '' ORDER BY rank) AS node,
  string_agg('문서 ' || (n - rank + 1) || ':' || chr(10) || '[출처: ' || source || ' | 페이지: ' || page || ']' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank DESC) AS paged,
  string_agg('- ' || source || ' (p.' || page || '): ' || text, chr(10) ORDER BY rank) AS bullet FROM top3 GROUP BY 1""")
def format_context(t: Tables) -> DataFrame:
    rows, sep = _top3(t), C.LAYOUT_SEPARATORS
    fields = ["source", "lang", "page_num", "text"]
    layouts = {
        "merged": (lambda i, h: C.block_merged(i, h["source"], h["page_num"], h["text"]), False),
        "ranked": (lambda i, h: C.block_ranked(h["rank"], F.lit("2024"), h["source"], h["lang"], h["text"]), True),
        "node": (lambda i, h: C.block_node(i, h["source"], h["text"]), False),
        "paged": (lambda i, h: C.block_paged(i, h["source"], h["page_num"], h["text"]), True),
        "year": (lambda i, h: C.block_year(F.lit("2024"), h["source"], h["text"]), True),
        "bullet": (lambda i, h: C.block_bullet(h["source"], h["page_num"], h["text"]), False),
    }
    out = search.format_layouts(rows, {n: (block, sep[n], back) for n, (block, back) in layouts.items()}, fields)
    return out.withColumn("ranked", C.framed(F.col("ranked")))


@query("reverse_repack", f"""{SQL_TOP3} SELECT query_id, string_agg(text, chr(10) ORDER BY rank DESC) AS context FROM top3 GROUP BY 1""")
def reverse_repack(t: Tables) -> DataFrame:
    return search.format_hits(_top3(t), lambda i, h: h["text"], "\n", ["text"], reverse=True)


SQL_REFILL = f"""WITH {SQL_DOCS}, {roles.SQL_QA},
rows_in AS (SELECT qa_id, question, CASE WHEN turn >= 2 THEN ['[label] ' || qa_id] ELSE contexts END AS contexts FROM qa),
needy AS (SELECT * FROM rows_in WHERE len(list_filter(contexts, lambda x: length(x) >= 120)) = 0),
asked_text AS (SELECT qa_id AS query_id, question FROM needy), {sql_weights('docs')},
cand AS (SELECT s.query_id, s.chunk_id, s.rscore AS score, d.text, list_distinct({sql_tokens('question')}) AS qs, list_distinct({sql_tokens('d.text')}) AS ps
  FROM (SELECT *, round(1.0::DOUBLE / (60 + rank), 6) AS rscore FROM sparse WHERE rank <= 50) s JOIN docs d USING (chunk_id) JOIN asked_text USING (query_id)),
j AS (SELECT *, round(coalesce(len(list_intersect(qs, ps)) / nullif(len(qs), 0), 0), 6) AS rs FROM cand),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, score DESC, chunk_id) AS rank FROM j),
fresh AS (SELECT query_id, string_agg(text, '|' ORDER BY rank) AS c FROM r WHERE rank <= 5 GROUP BY 1)
SELECT qa_id, f.c IS NOT NULL AS refilled, coalesce(f.c, array_to_string(contexts, '|')) AS contexts FROM rows_in LEFT JOIN fresh f ON f.query_id = qa_id"""


@query("refill_contexts", SQL_REFILL)
def refill_contexts(t: Tables) -> DataFrame:
    label = F.array(F.concat(F.lit("[label] "), F.col("qa_id").cast("string")))
    rows = roles.qa(t).select("qa_id", "question", F.when(F.col("turn") >= 2, label).otherwise(F.col("contexts")).alias("contexts"))
    out = search.refill_contexts(rows, "qa_id", "question", "contexts",
                                 lambda needy: search.preset_search("refill", docs(t), needy))
    return out.select("qa_id", "refilled", F.array_join("contexts", "|").alias("contexts"))

"""Explicit schemas for every stored entity; readers never infer."""

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


METADATA = _struct(year=S, category=S, target=S, entity=S)

NOTICE = _struct(notice_id=S, title=S, date=S, url=S, content=S,
                 attachments=T.ArrayType(S), images=T.ArrayType(S))
REFINED_NOTICE = _struct(title=S, date=S, url=S, metadata=METADATA, refined_content=S)
NOTICE_CHUNK = _struct(chunk_id=S, parent_id=S, metadata=METADATA, chunk_text=S)
RULE_CHUNK = _struct(doc_id=S, page_num_raw=S, page_num=I, prev_page=I, next_page=I, text=S, source=S)
QA_PAIR = _struct(question_type=S, question=S, ground_truth=S, context_used=S, source_file=S)
JUDGED_QA = T.StructType(
    QA_PAIR.fields
    + _struct(text_rag_answer=S, vision_rag_answer=S, retrieved_sources=T.ArrayType(S),
              route=S, judge_reason=S).fields
)
EVALUATION_ROW = _struct(question=S, ground_truth=S, answer=S, contexts=T.ArrayType(S), pipeline=S,
                         route_gold=S, route_pred=S, question_type=S, source_file=S, context_used=S)
METRIC_ROW = _struct(faithfulness=D, answer_relevancy=D, context_precision=D,
                     answer_correctness=D, context_recall=D)
SFT_ROW = _struct(instruction=S, input=S, output=S)
CHAT_ROW = _struct(messages=T.ArrayType(_struct(role=S, content=S)))
PREFERENCE_PAIR = _struct(prompt=S, chosen=S, rejected=S,
                          analysis=_struct(text_latency=D, is_complex=B))
ROUTE_REPORT = _struct(question=S, actual_label=S, is_correct=S)
LATENCY_RECORD = _struct(ID=I, Query=S, baseline_s=D, staged_s=D, speedup=D, stage1_s=D)
CHAT_MESSAGE = T.StructType(
    _struct(id=S, role=S, content=S, status=S).fields
    + [T.StructField("sources", T.ArrayType(_struct(doc_id=S, title=S, file_url=S))),
       T.StructField("created_at", T.TimestampType())]
)

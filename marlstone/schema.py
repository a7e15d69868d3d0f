"""Schemas of the records that the stages exchange."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

CATALOG = _struct(doc_name=_S, doc_link=_S, doc_type=_S, company=_S, doc_period=_S)
LAYOUT_SPAN = _struct(doc_name=_S, page=_I, page_height=_D, block=_I, line=_I, span=_I, text=_S, size=_D, bold=_B, x0=_D, y0=_D, x1=_D, y1=_D)
TABLE_CELL = _struct(doc_name=_S, page=_I, table_no=_I, row_no=_I, col_no=_I, cell=_S, x0=_D, y0=_D, x1=_D, y1=_D)
TOC = _struct(doc_name=_S, level=_I, title=_S, page=_I)
CELL_RECORD = _struct(row_label=_S, column_header=_S, raw_value=_S, value=_D)
TABLE_DATA = _struct(table_id=_S, row_range=T.ArrayType(_I), table_title=_S, unit_hint=_S, rows=T.ArrayType(CELL_RECORD), table_image=_S)
CHUNK = _struct(
    chunk_id=_S, doc_name=_S, doc_type=_S, company=_S, doc_period=_S, chunk_type=_S, section=_S, section_id=_S, page_start=_I, page_end=_I,
    chunk_index=_I, n_tokens=_I, text=_S, structured=TABLE_DATA, prev_chunk_id=_S, next_chunk_id=_S, source=T.MapType(_S, _S),
)
GLOSSARY_ENTRY = _struct(term=_S, definition=_S, doc_name=_S, page_num=_I, section=_S, pattern_type=_S)
GLOSSARY_ROLLUP = _struct(term=_S, definitions=T.ArrayType(_S), doc_count=_L, example_doc=_S)
QA = _struct(qa_id=_S, company=_S, doc_name=_S, question=_S, answer=_S, evidence=T.ArrayType(_struct(evidence_text=_S)))
PASSAGE = _struct(chunk_id=_S, doc_name=_S, page_start=_I, score=_D, text=_S)
ANSWER = _struct(
    qa_id=_S, company=_S, doc_name=_S, question=_S, ground_truth=_S, ground_truth_evidence=_S, generated_answer=_S,
    retrieved_passages=T.ArrayType(PASSAGE), retrieval_time_s=_D, generation_time_s=_D, total_inference_time_s=_D,
)
EXTRACTION_REPORT = _struct(doc_name=_S, status=_S, n_pages=_L, n_chunks_narrative=_L, n_chunks_table=_L, n_glossary_entries=_L, timing_s=_D, error=_S)
DOWNLOAD_REPORT = _struct(doc_name=_S, doc_link=_S, status=_S, error=_S)

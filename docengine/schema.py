"""Record types of the engine: parsed documents, chunks, scored chunks, passages, question pairs, reports, logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



SPAN = "struct<text:string,char_start:int,char_end:int,n_tokens:int>"
SECTION = "struct<heading:string,level:int,section_number:string,char_start:int,char_end:int>"
PAGE = "struct<page_number:int,char_start:int,char_end:int>"
TABLE = "struct<markdown:string,char_start:int,char_end:int,n_rows:int,n_cols:int>"
PARSED_DOC = (
    "doc_id string, doc_title string, doc_type string, module string, metadata map<string,string>, full_text string, "
    f"pages array<{PAGE}>, sections array<{SECTION}>, tables array<{TABLE}>, n_chars int"
)
#: Metadata of a chunk and its default where a document lacks it; years and quarters stay null.
METADATA = {
    "regulatory_body": "", "jurisdiction": "", "doc_version": "", "effective_date": "", "company_ticker": "", "company_name": "",
    "fiscal_year": None, "fiscal_quarter": None, "industry_sector": "", "naics_code": "", "filing_date": "",
}
CHUNK = (
    "chunk_id string, doc_id string, doc_title string, doc_type string, module string, chunk_strategy string, chunk_index int, content string, content_tokens int, "
    "char_start int, char_end int, section_title string, section_number string, hierarchy_path string, parent_chunk_id string, chunk_level string, contains_table boolean, "
    "section_type string, regulatory_body string, jurisdiction string, doc_version string, effective_date string, company_ticker string, company_name string, "
    "fiscal_year int, fiscal_quarter int, industry_sector string, naics_code string, filing_date string"
)
SCORED_CHUNK = "query_id string, chunk_id string, score double, rank int"
PASSAGE = (
    "passage_id string, module string, source_doc_id string, source_doc_title string, source_doc_type string, passage_text string, char_start int, char_end int, "
    "n_tokens int, page_number int, section_title string, section_number string"
)
QA_PAIR = (
    "qa_id string, track string, module string, question string, question_type string, difficulty string, key_concepts array<string>, source_passage_id string, "
    "source_passage_text string, char_start int, char_end int, source_doc_id string, reference_answer string, reference_answer_model string"
)
WARNING = "struct<severity:string,code:string,message:string>"
LOG_RECORD = (
    "query_id string, ts string, query string, config map<string,string>, timings map<string,double>, transformed_queries array<string>, "
    "top_chunks array<struct<chunk_id:string,doc_id:string,section_title:string,section_number:string,score:double,char_start:int,char_end:int,content_preview:string>>, "
    "answer string, guardrails string"
)
#: Columns of the vector collections that retrieval filters use.
FILTER_COLUMNS = ("doc_id", "doc_type", "section_type", "chunk_level", "regulatory_body", "jurisdiction", "company_ticker", "industry_sector", "contains_table", "fiscal_year", "fiscal_quarter")


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def metadata_columns(metadata: str = "metadata") -> list[Column]:
    """The chunk metadata columns of a document's string map, with their defaults; numbers that don't parse are null."""
    out = []
    for name, default in METADATA.items():
        value = F.try_element_at(F.col(metadata), F.lit(name))
        out.append((value.try_cast("int") if default is None else F.coalesce(value, F.lit(default))).alias(name))
    return out

"""The schemas of the tables that this library reads and writes."""

from __future__ import annotations

SOURCES = (
    "source_id string, name string, base_url string, seed_urls array<string>, allowed_domains array<string>, excluded_patterns array<string>, "
    "category string, authority_level int, crawl_depth int, max_pages int, enabled boolean"
)
MANIFEST = (
    "doc_id string, url string, local_path string, mime_type string, status_code int, content_hash string, crawl_time timestamp, "
    "source_id string, title string, parent_url string"
)
DOCUMENTS = (
    "doc_id string, title string, source_url string, source_type string, category string, department string, authority_level int, "
    "published_date string, effective_year int, status string, hash string, local_path string, text string, metadata map<string,string>"
)
CHUNK_METADATA = "struct<title:string,url:string,source_type:string,category:string,effective_year:int,status:string>"
CHUNKS = (
    "chunk_id string, doc_id string, parent_id string, chunk_index int, section_path array<string>, page_start int, page_end int, "
    f"text string, embedding_text string, display_text string, token_count int, hash string, metadata {CHUNK_METADATA}"
)
EVAL_CASES = (
    "question_id string, question string, type string, reference_answer string, required_facts array<string>, relevant_doc_ids array<string>, "
    "relevant_chunk_ids array<string>, answerable boolean, effective_year int, source_title string, source_url string"
)

"""Declared schemas of files and tables; nothing is inferred."""

from __future__ import annotations

CHUNK = (
    "chunk_id string, document_title string, section_code string, article string, page_number int, page_start int, "
    "page_end int, heading_path array<string>, chunk_index int, content string, source_path string"
)
ARTICLE = (
    "source_name string, source_article_id string, title string, summary string, content string, article_url string, "
    "author string, published_at timestamp, tags array<string>, raw_payload string"
)
EVAL_CASE = (
    "name string, messages array<string>, expected_intent string, expected_tool string, expected_action string, "
    "must_include array<string>, must_not_include array<string>, expected_answer_status string"
)
TURN = "struct<role: string, message: string, created_at: timestamp, intent: string, tool_name: string>"
SESSION = (
    f"struct<session_id: string, history: array<{TURN}>, updated_at: timestamp, summary: string, "
    "summary_updated_at: timestamp, compacted_turn_count: int>"
)
MEMORY = (
    "struct<memory_id: string, content: string, memory_type: string, owner_id: string, confidence: double, "
    "source_session_id: string, created_at: timestamp, updated_at: timestamp>"
)
REQUIRED_CASE_FIELDS = ("name", "messages", "expected_intent", "expected_tool", "expected_action")
# Longest accepted article fields.
ARTICLE_LENGTHS = {"source_name": 64, "source_article_id": 255, "title": 512, "author": 255}
ARTICLE_REQUIRED = ("source_name", "title", "article_url")

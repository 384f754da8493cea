"""Schemas of the library's tables, as DDL."""

FILES = "path string, content_hash string, size long, modified_at timestamp, indexed_at timestamp"
SYMBOLS = "id string, name string, kind string, file_path string, parent string, start_line int, end_line int, signature string"
EDGES = "source_id string, target_id string, edge_type string, weight double"
CHUNKS = "id long, file_path string, start_line int, end_line int, content_hash string, chunk_text string"
POSTINGS = "term string, doc_id long, pos int"
VECTORS = "id string, vector array<float>, model_version string, created_at timestamp"
ALIASES = "alias_term string, resolved_path string, resolved_symbol string, resolved_line int, hit_count long, confidence double, created_at timestamp, last_used_at timestamp"
TOOL_CALLS = "tool_name string, operation string, started_at timestamp, duration_ms long, tokens_original long, tokens_optimized long, error_message string"
SKILLS = "name string, relative_path string, content string, source string, source_path string"
SEMANTIC = (
    "name string, title string, description string, intent string, triggers array<string>, micro_rules array<string>, "
    "keywords array<string>, headings array<string>, action_triggers array<string>, file_patterns array<string>, "
    "applicable_phases array<string>, summary_snippet string"
)
#: Columns of SEMANTIC that follow from the others.
IMPLIED = ("action_triggers", "file_patterns", "applicable_phases", "summary_snippet")
LEARNINGS = "ord long, category string, content string, is_pinned boolean"

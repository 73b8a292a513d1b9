"""Schemas of the library's tables, as DDL."""

from __future__ import annotations

MEMORY = """namespace string, id string, user_id string, domain string, content string, embedding array<float>, main_content string,
 subcontent string, metadata map<string,string>, created_at timestamp, updated_at timestamp"""
HAS_EVENT = """user_id string, date string, event_name string, `desc` string, year string, time string, date_expression string,
 embedding array<float>"""
SYMBOL = """org_id string, repo string, file_path string, qualified_name string, symbol_name string, symbol_type string, language string,
 signature string, docstring string, summary string, summary_source string, raw_code string, content_hash string, start_line int,
 end_line int, line_count int, parent_class string, is_public boolean, is_entrypoint boolean, complexity_bucket string,
 summary_embedding array<float>, code_embedding array<float>"""
FILE = """org_id string, repo string, file_path string, language string, raw_content string, summary string, summary_source string,
 total_lines int, symbol_count int, symbol_names array<string>, content_hash string, commit_sha string, summary_embedding array<float>"""
CALLS = """org_id string, repo string, caller_file string, caller_qname string, callee_file string, callee_qname string,
 is_direct boolean, is_ambiguous boolean"""
IMPORTS = "org_id string, repo string, importer_file string, imported_file string, import_type string"
ANNOTATION = """annotation_id string, project_id string, org_id string, repo string, content string, annotation_type string,
 severity string, status string, author_id string, author_name string, author_role string, file_path string, symbol_name string,
 assigned_to string, created_at string, updated_at string"""
OPS = "op_id bigint, user_id string, domain string, type string, content string, embedding_id string, reason string"
EXECUTED_OPS = "op_id bigint, type string, status string, content string, embedding_id string, new_id string, error string"
ANALYTICS_EVENT = """event string, ts timestamp, method string, path string, status int, latency_ms double, user_id string,
 request_id string, provider string, model string, agent string, input_tokens bigint, output_tokens bigint, total_tokens bigint,
 success boolean, error string"""

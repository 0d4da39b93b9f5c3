"""Explicit schemas of the logical tables the operators exchange."""

from __future__ import annotations

FILES = "repo string, path string, ord bigint, content string"
PAYLOADS = "path string, status int, encoding string, content string"
UNITS = ("unit_id bigint, repo string, file string, name string, start_line int, line_count int, "
         "lang_group string, code string, n_chars int, scan_ord bigint")
DUP_PAIRS = ("lang_group string, a struct<file:string,name:string,line:int>, "
             "b struct<file:string,name:string,line:int>, similarity double")
SHINGLE_PAIRS = ("lang_group string, a_id bigint, b_id bigint, a_copies bigint, b_copies bigint, "
                 "inter bigint, union_size bigint")
STRUCTURES = "repo string, file string, ord bigint, imports array<string>, symbols array<string>"
EDGES = "repo string, src_file string, dst_module string"
DIFFS = "owner string, repo string, pr_number int, diff string"
REQUESTS = "key string, kind string, prompt string, truncated boolean"
ANSWERS = "key string, kind string, raw string, error_category string, error_message string"
FINDINGS = "key string, pos int, severity string, description string, confidence string"
DELIVERIES = "delivery_id string, ts timestamp, event_type string, signature string, body string"
FETCH_LOG = "key string, http_status int, rate_remaining string, error string, body_blank boolean"

"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

CHUNK = "chunk_id string, level int, type string, repo string, module string, file_path string, language string, name string, content string, docstring string, start_line int, end_line int"
DETAIL = "repo string, language string, file_path string, name string, type string, content string, hash string"
ACCESS = "last_access_time double, access_count int, correct_count int, total_use_count int, created_time double"
#: Whole access-record objects map a document's id to its record.
ACCESS_MAP = f"map<string, struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ACCESS.split(', '))}>>"
GENERATION = "task_id string, solution string"
RESULT = "experiment string, problem_id int, model string, mode string, pass_at_1 double, kw_score double, latency double, vram double, forgotten int, old_ratio double, answer string"
EVAL = "eval map<string, array<struct<base_status:string, plus_status:string>>>"
COLLECTIONS = ("summary", "chunks", "details")

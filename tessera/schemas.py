"""Explicit schemas of the engine's relations; nothing is inferred."""

from __future__ import annotations

SCHEMA_VERSION = 4

FILES = "path string, pkg string, lang string, mtime_ms double, hash string, text string"
PACKAGES = "name string, dir string, role string, deps array<string>"
RANGE = "start_line int, end_line int, start_char int, end_char int"
NODES = f"file string, node_id string, parent_id string, depth int, ord int, name string, kind string, is_symbol boolean, {RANGE}"
SYMBOLS = "id string, name string, kind string, file string, pkg string, start_line int, end_line int"
CHUNKS = "row_id long, id string, name string, kind string, file string, pkg string, start_line int, end_line int, text string"
POSTINGS = "term string, id string, file string, tf long, dl long"
EDGES = "src string, dst string"
NAMESPACES = "prefix string, root string, ord int"
DIAGS = "file string, code long, message string, line int, ord int"
META = "version int, created_ms string, updated_ms string, model string, dims int, root string, monorepo boolean"
FINGERPRINT = "path string, hash string"
EMBEDDED = "row_id long, embedding array<float>"

#: The kinds of symbols, package roles and languages.
SYMBOL_KINDS = ["function", "class", "interface", "enum", "type", "var", "method", "struct"]
ROLES = ["backend", "frontend", "mobile", "shared", "docs", "unknown"]
LANGUAGES = ["ts", "tsx", "rust", "python", "js", "go", "java", "php", "ruby", "c", "cpp", "swift", "other"]

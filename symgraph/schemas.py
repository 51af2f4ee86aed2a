"""Schemas of the engine's tables, as DDL. Tables are partitioned by project and branch."""

from __future__ import annotations

_HOME = "project string, branch string, "

FILES = _HOME + "path string, content string, modified bigint"
SYMBOLS = _HOME + (
    "file string, symbol string, type string, language string, content string, line int, calls array<string>, last_modified bigint"
)
POINTS = _HOME + (
    "chunk_id string, symbol string, file_path string, content string, summary string, language string, type string, "
    "tags array<string>, last_modified bigint, responsibilities array<string>, business_context string, calls array<string>, "
    "called_by array<string>, chunk_number int, chunk_count int, embedding array<float>"
)
MANIFEST = _HOME + "chunk_id string, file string, symbol string, content_hash string, embedded_hash string, updated_at bigint"
NODES = _HOME + "id string, kind string, name string, file string, line int, summary string"
EDGES = _HOME + "src string, dst string, kind string"
META = _HOME + "key string, value string"
PROJECTS = "name string, path string"

#: Keys of the tables that are replaced row by row.
KEYS = {
    "points": ("project", "branch", "file_path", "symbol", "chunk_number"),
    "manifest": ("project", "branch", "file", "symbol", "chunk_id"),
    "nodes": ("project", "branch", "id"),
    "edges": ("project", "branch", "src", "dst", "kind"),
    "meta": ("project", "branch", "key"),
    "projects": ("name",),
}

SYMBOL_KINDS = ("func", "method", "type", "const")

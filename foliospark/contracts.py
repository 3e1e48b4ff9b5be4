"""The JSON outputs' schemas, as DDL to read them with: ``F.from_json("value", CONTRACTS["info"])``."""

from __future__ import annotations

from foliospark.errors import ERROR_TYPE, WARNING_TYPE

_TEXTS = "author, last_modified_by, created_at, modified_at, revision, application, company"
_COUNTS = "word_count, page_count, slide_count, worksheet_count"
_INFO = ", ".join([*(f"{n}: string" for n in _TEXTS.split(", ")), *(f"{n}: bigint" for n in _COUNTS.split(", ")), "custom_properties: map<string, string>", "has_macros: boolean"])
_SIGNALS = "array<struct<kind: string, severity: string, path: string, message: string>>"
_AUDIT = f"engine_version: string, file: string, document_type: string, metadata: struct<file: string, {_INFO}>, signals: {_SIGNALS}"
_BLOCK = "type: string, text: string"
_TABLE = "complete: boolean, grid_column_count: int, rows: array<struct<row_ordinal: int, grid_before: int, grid_after: int, complete: boolean, cells: array<struct<cell_ordinal: int, grid_start: int, grid_span: int, vertical_merge: string, complete: boolean, blocks: {}>>>>"


def _tables(depth: int) -> str:
    """Tables within tables, as deep as asked; the rows of deeper ones are read as JSON text, which is all of them."""
    block = f"array<struct<{_BLOCK}, complete: boolean, grid_column_count: int, rows: string>>"
    for _ in range(depth):
        block = f"array<struct<{_BLOCK}, {_TABLE.format(block)}>>"
    return f"array<struct<part_type: string, part_path: string, table_ordinal: int, {_TABLE.format(block)}>>"


CONTRACTS = {
    "info": f"struct<engine_version: string, file: string, {_INFO}>",
    "text": "struct<file: string, text: string>",
    "text-jsonl": f"struct<file: string, document_type: string, text: string, error: {ERROR_TYPE}, warnings: array<{WARNING_TYPE}>>",
    "structured-text": "struct<file: string, document_type: string, blocks: array<struct<part_type: string, part_path: string, ordinal: int, text: string>>>",
    "docx-tables": f"struct<schema_version: int, file: string, document_type: string, tables: {_tables(3)}, warnings: array<{WARNING_TYPE}>>",
    "audit": f"struct<{_AUDIT}>",
    "audit-jsonl": f"struct<schema_version: int, file: string, document_type: string, audit: struct<{_AUDIT}>, error: {ERROR_TYPE}, warnings: array<{WARNING_TYPE}>>",
    "rows-jsonl": "struct<schema_version: int, file: string, sheet_name: string, sheet_index: int, row_index: bigint, cells: array<struct<column_index: int, kind: string, raw: string, value: string, formatted: string, has_formula: boolean>>>",
    "schema": "struct<schema_version: int, experimental: boolean, file: string, sheet_name: string, sheet_index: int, scan: struct<mode: string, sample_rows: int, examined_rows: bigint>, header_policy: string, columns: array<struct<column_index: int, name: string, logical_type: string, nullable: boolean, observed_types: array<string>>>, warnings: array<struct<code: string, message: string, column_index: int>>>",
    "manifest": f"struct<engine_version: string, file: string, sheets: array<struct<index: int, name: string, visibility: string, csv_path: string, warnings: array<{WARNING_TYPE}>, error: {ERROR_TYPE}>>>",
}

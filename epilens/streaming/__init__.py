"""Structured Streaming forms of the batch operators."""

from .incremental import CASE_CSV_SCHEMA, case_file_stream, keyed_rows, newest, totals_from_rows, update_case_rows

__all__ = ["CASE_CSV_SCHEMA", "case_file_stream", "keyed_rows", "newest", "totals_from_rows", "update_case_rows"]

"""What constants and plain text say of files: decided branches, and functions of files in any state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.constants import folded_branches
from ..session import parallel
from .scopes import split_functions


def branches(code_files: DataFrame) -> DataFrame:
    """(file_id, language, line_no, condition, value) of the conditions that constants decide."""
    schema = "file_id bigint, language string, line_no int, condition string, value boolean"

    def run(batches):
        for batch in batches:
            rows = [(i, lang, *r) for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "code")), strict=True) if text for r in folded_branches(text, lang == "java")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()))], ["file_id", "language", "line_no", "condition", "value"])

    return parallel(code_files.select("file_id", "language", "code")).mapInArrow(run, schema)


def functions(code_files: DataFrame) -> DataFrame:
    """(file_id, name, params, body) of functions found by indentation or braces."""

    def run(batches):
        for batch in batches:
            rows = [(i, *r) for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "code")), strict=True) if text for r in split_functions(text, lang == "java")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()))], ["file_id", "name", "params", "body"])

    return parallel(code_files.select("file_id", "language", "code")).mapInArrow(run, "file_id bigint, name string, params array<string>, body string")

"""Documents as layout: a parser turns file bytes into spans, table cells and contents entries.

No PDF library is assumed: the parser is a callable. A file that it can't read becomes a report row."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schema

#: bytes -> {"spans": [...], "cells": [...], "toc": [...]}, rows as in the schemas without doc_name.
Parser = Callable[[bytes], dict]


#: Parsers by name; a caller adds those of its libraries.
PARSERS: dict[str, Parser] = {"json": json.loads}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, content`` of the files below a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("doc_name"), "content")


def open_documents(files: DataFrame, parse: Parser | str = "json") -> DataFrame:
    """``doc_name, status, error, layout`` (JSON) of every file; failures stay with their document."""
    parse = PARSERS[parse] if isinstance(parse, str) else parse

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                try:
                    row = ("ok", None, json.dumps(parse(content.as_py())))
                except Exception:
                    row = ("failed", traceback.format_exc(limit=3), None)
                yield pa.RecordBatch.from_pydict({"doc_name": [name.as_py()], "status": [row[0]], "error": pa.array([row[1]], pa.string()), "layout": pa.array([row[2]], pa.string())})

    named = files.select(F.col("doc_name").cast("string").alias("doc_name"), F.col("content").cast("binary").alias("content"))
    return named.mapInArrow(run, "doc_name string, status string, error string, layout string")


def layout_table(opened: DataFrame, part: str) -> DataFrame:
    """The rows of one part: spans, cells or toc."""
    record = {"spans": schema.LAYOUT_SPAN, "cells": schema.TABLE_CELL, "toc": schema.TOC}[part]
    inner = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in record if f.name != "doc_name")
    rows = F.from_json(F.get_json_object("layout", f"$.{part}"), f"array<struct<{inner}>>")
    return opened.where("status = 'ok'").select("doc_name", F.explode(rows).alias("r")).select("doc_name", "r.*")

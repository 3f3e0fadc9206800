"""CSV files whose rows and headers don't agree in width, each with a header of its own, as one scan.

Files come through Spark's own binary reader, so they may lie wherever Spark
can read, many small ones in a task. A file is parsed by the task that reads
it and held whole there, as a quoted field may hold line breaks.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "path string, content binary"


def records(payload: bytes, encoding: str = "latin-1") -> tuple[list[str], list[list[str]]]:
    """(header, rows) of a file, all as wide as its widest row; names past the header's end are ``_unnamed_`` and their place.

    Rows without anything but blanks are left out; quoted fields may hold
    commas, quotes and line breaks; a byte order mark goes whatever the
    encoding makes of it. An empty file has no names and no rows.
    """
    mark = "﻿".encode()
    text = payload.removeprefix(mark).decode(encoding, "replace")
    found = [row for row in csv.reader(io.StringIO(text, newline="")) if any(x.strip() for x in row)]
    if not found:
        return [], []
    width = max(map(len, found))
    padded = [[*row, *[""] * (width - len(row))] for row in found]
    return [name.lstrip("﻿").strip() or f"_unnamed_{i}" for i, name in enumerate(padded[0])], padded[1:]


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def ragged_headers(spark: SparkSession, paths: list[str], encoding: str = "latin-1") -> DataFrame:
    """``(path, header, rows)``: a row for each file that has a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [records(x.as_py(), encoding) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([h for h, _ in parsed], pa.list_(pa.string())), pa.array([len(r) for _, r in parsed], pa.int64())], ["path", "header", "rows"])

    return _files(spark, paths).mapInArrow(run, "path string, header array<string>, rows long")


def read_ragged(spark: SparkSession, paths: list[str], columns: list[str], encoding: str = "latin-1", renamed: dict[str, str] | None = None) -> DataFrame:
    """``(path, line, columns)``: every row of all files with the asked columns as text, by name in each file's own header.

    Columns that a file lacks are null; ``renamed`` gives today's names of old
    ones; of a name that a header repeats the first column counts. ``line`` is
    the row's place in its file, from 1. Only the asked columns leave the parser.
    """
    renamed = renamed or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                header, rows = records(content.as_py(), encoding)
                named = [renamed.get(n, n) for n in header]
                at = [named.index(c) if c in named else None for c in columns]
                arrays = [pa.array([None] * len(rows) if i is None else [row[i] for row in rows], pa.string()) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int32()), *arrays], ["path", "line", *columns])

    schema = ", ".join(["path string", "line int", *[f"`{c}` string" for c in columns]])
    return _files(spark, paths).mapInArrow(run, schema)


def file_name(path: str = "path"):
    """A path's last part."""
    return F.element_at(F.split(F.col(path), "/"), -1)

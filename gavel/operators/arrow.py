"""Plain Python functions of texts as Arrow batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def each_text(df: DataFrame, id_col: str, text_col: str, function: Callable[[str | None], str | None], name: str) -> DataFrame:
    """`id_col` and `name`, the function's value of each text; the function also sees nulls."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([function(t) for t in b.column(1).to_pylist()], pa.string())], [id_col, name])

    return df.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, `{name}` string")


def rows_of_text(df: DataFrame, id_col: str, text_col: str, function: Callable[[str | None], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """`id_col` and the columns of every row that the function makes of a text."""
    kind = df.schema[id_col].dataType.simpleString()
    types = [_ARROW[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [function(text) for text in b.column(1).to_pylist()]
            ids = b.column(0).take(pa.array([k for k, rows in enumerate(made) for _ in rows], pa.int64()))
            rows = list(zip(*(row for rows in made for row in rows), strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], [id_col, *columns])

    shape = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    return df.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"`{id_col}` {kind}, {shape}")

"""Shared by the operators of this folder: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows gathered before a batch is handed back to Spark.
OUT_ROWS = 4096


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs ``fn`` over each partition's rows as plain tuples, in bounded batches.

    ``fn`` gets an iterator over the rows of a partition and yields the rows of ``schema``. Nothing is
    gathered beyond one Arrow batch on either side, so memory does not grow with the partition.
    """
    names = [part.strip().split(" ")[0] for part in _split_fields(schema)]
    types = _arrow_types(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = batch.columns
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in columns)

        held: list[tuple] = []
        for row in fn(rows()):
            held.append(row)
            if len(held) == OUT_ROWS:
                yield _batch(held, names, types)
                held = []
        if held:
            yield _batch(held, names, types)

    return df.mapInArrow(run, schema)


def _batch(held: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _split_fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string (commas inside angle brackets stay)."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def _arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]

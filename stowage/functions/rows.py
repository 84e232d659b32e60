"""Functions of rows in Python, held to a few megabytes of results however many rows a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Bytes of results that a worker gathers before it hands them on.
HELD = 4 << 20


def size_of(value) -> int:
    """The bytes that a value takes, about."""
    if isinstance(value, (bytes, str)):
        return len(value)
    if isinstance(value, dict):
        value = value.values()
    return sum(map(size_of, value)) if hasattr(value, "__iter__") else 8


def by_row(function: Callable, kind: str, *columns: Column, random: bool = False) -> Column:
    """``function`` over the values of every row, nulls as None; a dictionary for a struct.

    Values are taken from the batch one row at a time and results go back
    in pieces of :data:`HELD` bytes, so a worker holds the batch that Spark
    hands it and little else. Steps that follow each other belong into one
    function: each call of this one that a query makes takes a worker.
    ``random``: equal rows may give different results.
    """
    what = to_arrow_type(DataType.fromDDL(kind))

    def run(batches):
        for batch in batches:
            arrays, out, held = batch if isinstance(batch, tuple) else (batch,), [], 0
            for row in zip(*arrays, strict=True):
                out.append(function(*(x.as_py() for x in row)))
                held += size_of(out[-1])
                if held >= HELD:
                    yield pa.array(out, what)
                    out, held = [], 0
            yield pa.array(out, what)
            del batch, arrays, out

    given = pa.Array if len(columns) == 1 else tuple[(pa.Array,) * len(columns)]
    run.__annotations__ = {"batches": Iterator[given], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, kind)
    return (udf.asNondeterministic() if random else udf)(*columns)


def map_rows(df: DataFrame, function: Callable[..., Iterator[tuple]], schema: str | StructType, views: bool = False) -> DataFrame:
    """The rows that ``function`` yields for the values of each row, under ``schema``; held like those of :func:`by_row`. ``views``: binary values are views on the batch, not copies."""
    return map_partition(df, lambda rows: (made for row in rows for made in function(*row)), schema, views)


def map_partition(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str | StructType, views: bool = False) -> DataFrame:
    """The rows that ``function`` yields for all rows of a partition, which come one at a time and in order; otherwise like :func:`map_rows`."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields.fields]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([array_of(c, t) for c, t in zip(columns, types, strict=True)], names)

    def value(x: pa.Scalar):
        return memoryview(x.as_buffer()) if views and x.is_valid and pa.types.is_binary(x.type) else x.as_py()

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield tuple(map(value, row))
            del batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for made in function(given(batches)):
            size = size_of(made)
            if out and size >= HELD:
                yield batch_of(out)
                out, held = [], 0
            out.append(made)
            held += size
            del made
            if held >= HELD:
                yield batch_of(out)
                out, held = [], 0
        yield batch_of(out)

    return df.mapInArrow(run, fields)


def array_of(values: tuple, what: pa.DataType) -> pa.Array:
    """The values as an array; one long binary value is taken as it is, not copied."""
    if len(values) == 1 and pa.types.is_binary(what) and isinstance(values[0], bytes) and HELD <= len(values[0]) < 1 << 31:
        return pa.Array.from_buffers(what, 1, [None, pa.array([0, len(values[0])], pa.int32()).buffers()[1], pa.py_buffer(values[0])])
    return pa.array(values, what)


def unless_null(function: Callable) -> Callable:
    """The function, but null where any value is."""
    return lambda *values: None if any(x is None for x in values) else function(*values)

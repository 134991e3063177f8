"""Python over Arrow batches: what a function doesn't look at passes through untouched, whatever its type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def kept_with(df: DataFrame, keep: list[str], **inputs: Column) -> DataFrame:
    """A struct ``kept`` of the columns in keep, beside the inputs: names in kept can't clash with others."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in dict.fromkeys(keep)]).alias("kept"), *[c.alias(n) for n, c in inputs.items()])


def text_of(df: DataFrame, text_col: str) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(df[f"`{text_col}`"], F.lit(""))


def mapped(df: DataFrame, inputs: list[str], made: dict[str, str], run: Callable[..., dict], rows: int = 256) -> DataFrame:
    """df's other columns and those that run makes of lists of the inputs' values, some rows at a time."""
    fields = [f for f in df.schema.fields if f.name not in inputs]
    kept = [f.name for f in fields]
    schema = StructType([*fields, *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in made.items())).fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                found = run(*[part.column(c).to_pylist() for c in inputs])
                columns = [part.column(c) for c in kept] + [pa.array(found[n], KINDS[k]) for n, k in made.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return df.mapInArrow(apply, schema)

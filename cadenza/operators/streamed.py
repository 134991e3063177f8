"""Folds in order: each key's rows pass through a task one by one, and only the fold's state is in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Arrow's kinds by the names that DDL has for them.
KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def in_order(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], made: dict[str, str], fresh: Callable[[], Callable[..., tuple | None]], pass_on: tuple[str, ...] = (), descending: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, the columns in pass_on and those in made, for each row of which the fold makes something.

    fresh begins a key's fold and returns a function of a row's inputs, which returns the made values or
    None (the row goes). Rows of a key come by order (descending where it is named so, nulls last then);
    keys and other columns pass through untouched, whatever their types.
    """
    rows = df.select(*dict.fromkeys([*keys, *order, *pass_on, *inputs]))
    kept = list(dict.fromkeys([*keys, *order, *pass_on]))
    sort = [df[c].desc_nulls_last() if c in descending else df[c].asc() for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            whose = zip(*(batch.column(c).to_pylist() for c in keys))
            at, out = [], []
            for i, (key, values) in enumerate(zip(whose, zip(*(batch.column(c).to_pylist() for c in inputs)))):
                if fold is None or key != now and repr(key) != repr(now):
                    now, fold = key, fresh()
                found = fold(*values)
                if found is not None:
                    at.append(i)
                    out.append(found)
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in kept]
            columns += [pa.array([row[n] for row in out], KINDS[k]) for n, k in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    extra = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in made.items())).fields if made else []
    return rows.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInArrow(run, StructType([*[rows.schema[c] for c in kept], *extra]))

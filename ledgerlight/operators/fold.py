"""State machines over ordered rows, with memory for the state alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def headed(df: DataFrame, keys: list[str], schema: str) -> tuple[str, pa.Schema]:
    """The keys' types before a schema, and all of it as Arrow has it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return head, to_arrow_schema(_parse_datatype_string(f"{head}, {schema}"))


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[[tuple], tuple]], schema: str) -> DataFrame:
    """Run ``start()`` anew for each key and call it with every row, in order; it returns the row to emit, without the keys, or None.

    One exchange by key and a sort; the rows stream through in batches, so that no group is held. A key is one
    task at most, as each row needs what all before it have done.
    """
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[i] for i in at)
                if key != now or step is None:
                    now, step = key, start()
                made = step(row)
                if made is not None:
                    out.append(key + made)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    head, target = headed(df, keys, schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{head}, {schema}")


def ordered_summary(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], tuple[Callable[..., None], Callable[[], tuple]]], schema: str) -> DataFrame:
    """One row for each key: ``start()`` gives a step, called with the other columns of every row in order, and an end that gives the row.

    For what a state machine leaves behind: nothing is built for each row. Columns come in the order of ``df``, without the keys.
    """
    rest = [i for i, c in enumerate(df.columns) if c not in keys]
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, end, out = None, None, None, []
        for batch in batches:
            named = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            values = [batch.column(i).to_pylist() for i in rest]
            first = 0
            while first < len(named):
                if named[first] != now or step is None:
                    if end is not None:
                        out.append(now + end())
                    now = named[first]
                    step, end = start()
                last = len(named) if named[-1] == now else next(i for i in range(first, len(named)) if named[i] != now)
                for row in zip(*(v[first:last] for v in values), strict=True):
                    step(*row)
                first = last
        if end is not None:
            out.append(now + end())
        columns = list(zip(*out, strict=True)) if out else [[] for _ in target]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    head, target = headed(df, keys, schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{head}, {schema}")


def with_ordered_column(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, start: Callable[[], Callable[[float | None], float | None]]) -> DataFrame:
    """Add a double: what ``start()``'s function gives for ``value``, row by row of each key, in order. The other columns pass as they are."""
    at, source = [df.columns.index(k) for k in keys], df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            out = []
            for *key, x in zip(*(batch.column(i).to_pylist() for i in at), batch.column(source).to_pylist(), strict=True):
                if key != now or step is None:
                    now, step = key, start()
                out.append(step(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

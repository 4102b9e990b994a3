"""Sorted rows through a Python generator, for state machines that windows cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: rows of an output batch
OUT_ROWS = 1024


def sorted_map(rows: DataFrame, deal: Sequence[str], order: Sequence[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Deal rows out by ``deal``, sort them by ``order`` in each task, and run ``fn`` over the stream of tuples.

    Rows are handed over one by one, so memory is what ``fn`` keeps. Output tuples follow ``schema``.
    """
    names, fields = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def tuples(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in parts:
            yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), fields)], schema=fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in fn(tuples(parts)):
            held.append(row)
            if len(held) == OUT_ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return rows.repartition(*deal).sortWithinPartitions(*order).mapInArrow(run, schema)

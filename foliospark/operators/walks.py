"""Folds over the rows of a key in order, for rules where a row's part depends on the rows before it.

Rows are dealt and sorted by Spark. A batch holds the rows of many keys, so no key pays for a call of its own; rows of a key may reach
over batches, and a task holds one batch and the rows of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def walked(rows: DataFrame, key: str, order: list[str], walk: Callable[[list[tuple]], list[tuple]], fields: str) -> DataFrame:
    """(key, *fields): the tuples that ``walk`` makes of each key's rows, which it gets as tuples without the key, in order."""
    made = T.StructType.fromDDL(fields)
    schema, names = T.StructType([rows.schema[key], *made.fields]), [c for c in rows.columns if c != key]
    types = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kind = None, [], None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            keys, out = [k for k, each in found for _ in each], [row for _, each in found for row in each]
            columns = zip(*out, strict=True) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, *made.names])

        for b in batches:
            if not b.num_rows:
                continue
            keys, kind, found = b.column(key).to_pylist(), b.column(key).type, []
            each = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for start, end in pairwise([0, *ends, len(keys)]):
                if held and keys[start] != at:
                    found.append((at, walk(held)))
                    held = []
                at = keys[start]
                held += each[start:end]
            yield batch(found)
        if held:
            yield batch([(at, walk(held))])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

"""Ordered folds over groups, for decisions that depend on earlier decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    start: Callable[[], object],
    step: Callable[..., bool],
    output: str,
) -> DataFrame:
    """Add the boolean ``output`` = ``step(state, *inputs)`` with a fresh ``start()`` state per group.

    Spark hashes the rows on the keys and sorts them within partitions, where it
    can spill; a task then walks its groups in Arrow batches. It holds one batch
    and one state, however long a group is.
    """
    names, values = list(keys), list(inputs)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, previous = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = list(zip(*(batch.column(n).to_pylist() for n in names)))
            results = []
            for group, *row in zip(groups, *(batch.column(c).to_pylist() for c in values)):
                if group != previous:
                    state, previous = start(), group
                results.append(step(state, *row))
            columns = [*batch.columns, pa.array(results, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, output])

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.BooleanType())])
    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(walk, schema)

"""Rows that can't be the first of their key go before rows are dealt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each distinct value, null included, and how many there are."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _thinned(batch: pa.RecordBatch, keys: list[str], order: dict[str, str]) -> pa.RecordBatch:
    group = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        codes, n = _codes(batch.column(k))
        group = np.unique(group * n + codes, return_inverse=True)[1]  # numbers stay below the rows, whatever the keys
    ranks = [pc.rank(batch.column(c), sort_keys=way, null_placement="at_end", tiebreaker="dense").to_numpy() for c, way in order.items()]
    by = np.lexsort((*reversed(ranks), group))
    fresh = np.diff(group[by], prepend=-1) != 0
    head = by[fresh][np.cumsum(fresh) - 1]  # the first row of each row's group
    stays = np.zeros(batch.num_rows, bool)
    stays[by] = np.logical_and.reduce([r[by] == r[head] for r in ranks])
    for c in order:
        stays |= pc.is_null(batch.column(c), nan_is_null=True).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(stays))


def without_later(rows: DataFrame, keys: list[str], order: dict[str, str]) -> DataFrame:
    """rows without those that a row of equal keys in the same Arrow batch comes before; order names columns, each "ascending" or
    "descending", nulls last. Equal rows and rows with a null or NaN in the order all stay, so the first of each key is among what
    is left whatever an aggregate makes of them. It needs the memory of a batch; an aggregate whose buffer holds a string would
    sort, and at size spill, all rows of a task before it deals them.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _thinned(batch, keys, order) if batch.num_rows else batch

    return rows.mapInArrow(thin, rows.schema)

"""Whole groups of rows, many at a time, in Arrow.

A call of Python for each group costs more than a short group's work. Here a task takes sorted rows in batches that end with a group, so that one step of numpy goes
through all groups of a batch side by side. A task holds one batch of about ``ROWS`` rows, or one group if that is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a batch has at least, but for a task's last one.
ROWS = 131_072


class Groups:
    """Where the groups of sorted rows begin, and how many rows each has."""

    def __init__(self, size: np.ndarray):
        self.size, self.first = size, np.cumsum(size) - size

    @staticmethod
    def of(table: pa.Table, keys: list[str]) -> Groups:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            own = codes(table[k])
            new[1:] |= own[1:] != own[:-1]
        return Groups(np.diff(np.append(np.flatnonzero(new), table.num_rows)))

    def __len__(self) -> int:
        return len(self.size)

    def each(self) -> np.ndarray:
        """Of every row the number of its group."""
        return np.repeat(np.arange(len(self)), self.size)

    def steps(self, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(groups, rows): the first row of every group, then the second of every group that has one, and so on; with ``back`` from each group's last row."""
        order = np.argsort(-self.size, kind="stable")
        longest, ends = self.size[order], (self.first + self.size - 1)[order]
        starts, more = self.first[order], len(order)
        for t in range(int(longest[0]) if len(order) else 0):
            while longest[more - 1] <= t:
                more -= 1
            yield order[:more], ends[:more] - t if back else starts[:more] + t


def headed(table: pa.Table, groups: Groups, width: int) -> tuple[np.ndarray, pa.Table, Groups]:
    """What each group's first row tells if it is a header (groups, width), NaN for groups without one, and the rows and groups without headers."""
    body = table["_about"].is_null().to_numpy()
    held, told = ~body[groups.first], np.full((len(groups), width), np.nan)
    told[held] = arrays(table["_about"].filter(pa.array(~body)), width)
    return told, table.filter(pa.array(body)), Groups(groups.size - held)


def with_headers(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``rows`` and, of each group, one row more: its keys and an array of numbers ``_about``, missing in all other rows. Sort by whether ``_about`` is missing to have it first."""
    return rows.withColumn("_about", F.lit(None).cast("array<double>")).unionByName(headers, allowMissingColumns=True)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values of any type."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def doubles(table: pa.Table, columns: list[str]) -> np.ndarray:
    """(rows, columns), missing values as NaN."""
    return np.stack([table[c].cast(pa.float64()).to_numpy() for c in columns], axis=1) if columns else np.zeros((table.num_rows, 0))


def arrays(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """(rows, width) of a column of arrays that all have so many numbers, missing ones as NaN."""
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), width)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of arrays."""
    values = np.ascontiguousarray(values, float).reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.float64()))


def replaced(table: pa.Table, columns: list[str], values: np.ndarray) -> pa.Table:
    """The table with columns of these values (rows, columns); NaN goes missing."""
    for i, c in enumerate(columns):
        at = table.column_names.index(c)
        table = table.set_column(at, table.schema.field(at), pa.array(np.ascontiguousarray(values[:, i]), from_pandas=True).cast(table.schema.field(at).type))
    return table


def in_batches(rows: DataFrame, keys: list[str], order: list[Column], of: Callable[[pa.Table, Groups], pa.Table], schema, most: int = ROWS, parts: int | None = None) -> DataFrame:
    """``of(rows, groups)`` over all rows, in batches of whole groups that lie in ``order``. ``parts``: the number of partitions; there is no shuffle if the rows lie so already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                table = table.combine_chunks()
                yield from of(table, Groups.of(table, keys)).to_batches(max_chunksize=65_536)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= most:
                table = pa.Table.from_batches(held)
                end = int(Groups.of(table, keys).first[-1])
                yield from done(table.slice(0, end))
                held, count = table.slice(end).to_batches(), 0
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(*[parts] if parts else [], *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

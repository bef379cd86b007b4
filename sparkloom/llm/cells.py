"""Pairs within groups, computed in blocks: a group's rows are split by a hash, and each pair of blocks is a task's cell.

A cell holds at most two blocks, whatever the size of its group, and gives what its pairs amount to
(counts, a spanning forest), never the pairs.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_cells(rows: DataFrame, keys: list[str], blocks: Column, spread: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own is in; columns ``block, i, j`` are added and rows dealt by cell."""
    own = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    cell = [*keys, "i", "j"]
    return placed.repartition(*cell).sortWithinPartitions(*cell)


def each_cell(keys: list[str], columns: list[str], make: Callable[[dict], pa.RecordBatch | None]):
    """A ``mapInArrow`` function that calls ``make`` with the columns (as lists) of each cell of two rows or more."""
    fields = [*keys, "i", "j"]

    def run(batches):
        key, cell = None, {}
        for batch in batches:
            values = {c: batch.column(c).to_pylist() for c in [*fields, "block", *columns]}
            names = list(zip(*(values[c] for c in fields), strict=True))
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if names[i] != key:
                    if key is not None and len(cell["block"]) > 1 and (out := make(cell)) is not None:
                        yield out
                    key, cell = names[i], {c: [] for c in values}
                for c, v in values.items():
                    cell[c] += v[i:j]
                i = j
        if key is not None and len(cell["block"]) > 1 and (out := make(cell)) is not None:
            yield out

    return run


def sides(cell: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of the two blocks; None where the cell is one block with itself."""
    if cell["i"][0] == cell["j"][0]:
        return None
    block = np.array(cell["block"])
    return np.flatnonzero(block == cell["i"][0]), np.flatnonzero(block == cell["j"][0])


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that links reach, for each of n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new

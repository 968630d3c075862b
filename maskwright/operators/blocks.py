"""Helpers that see whole pages: many of them at a time as Arrow tables, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are handed over at a time, where that many are there; a page is never cut.
LEAST = 20_000


def by_page(df: DataFrame, order: list, go: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, key: str = "image_id") -> DataFrame:
    """``go`` over tables of whole pages, the rows of a page together and in ``order``.

    ``go`` takes a table and the places at which its pages begin, and returns the columns of ``schema``. Pages are as large
    as a task's memory; unlike a function per group, a small one costs nothing of its own.
    """
    shape = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                yield from go(t.drop_columns(["_nr"]), np.flatnonzero(t["_nr"].to_numpy() == 1)).select(shape).combine_chunks().to_batches()

        for batch in batches:
            begins = np.flatnonzero(batch.column("_nr").to_numpy() == 1)
            if len(begins) and sum(b.num_rows for b in held) + begins[-1] >= LEAST:
                held.append(batch.slice(0, begins[-1]))
                yield from out()
                held = [batch.slice(begins[-1])]
            else:
                held.append(batch)
        if held:
            yield from out()

    return df.withColumn("_nr", F.row_number().over(Window.partitionBy(key).orderBy(*order))).mapInArrow(run, schema)


def numbers(t: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns as numpy arrays of doubles; null is NaN."""
    return [t[c].cast(pa.float64()).to_numpy() for c in columns]

"""Shared helpers: tables in the cluster's shared folder, byte-balanced Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.packaging import ship
from docspark.staging import shared_dir, stored  # noqa: F401

def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text (null: empty); other columns can't clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of text each (a longer text stands alone)."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


SEND_KEYS = 1 << 20


def keyed_join(rows: DataFrame, table: DataFrame, on: list[str], most: int = SEND_KEYS) -> DataFrame:
    """Inner join of ``rows`` with a table of one row for each key, whatever share of the rows has one key.

    A table of at most ``most`` keys is sent to all tasks. Of a larger one only the keys that hold more than one ``most``-th of the
    rows are sent, of which there are fewer than ``most``; the other rows meet their keys by a shuffle.
    """
    if table.count() <= most:
        return rows.join(F.broadcast(table), on)
    heavy = stored(rows.groupBy(on).count().where(F.col("count") * most > rows.count()).select(on), "heavy-keys")
    sent = rows.join(F.broadcast(table.join(heavy, on, "left_semi")), on)
    return sent.unionByName(rows.join(F.broadcast(heavy), on, "left_anti").join(table, on))

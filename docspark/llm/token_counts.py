"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import common, tokenizing


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Batches are balanced by bytes and long texts are split where a word meets white space.
    Null and empty texts have no bytes and no tokens; repeated rows are counted each; an empty table
    gives an empty table; other columns are not read. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizing.encoder(tokenizer_path)
        for batch in batches:
            for part in common.slices(batch):
                _, at = enc.encode(part.column(1))
                yield pa.record_batch([part.column(0), pa.compute.cast(pa.compute.binary_length(part.column(1)), pa.int64()), pa.array(np.diff(at))], names=["doc_id", "n_bytes", "n_tokens"])

    counted = common.texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

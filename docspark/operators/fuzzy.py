"""Fuzzy label search: labels that text recognition has misspelt (L2, L3)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import layout
from docspark.packaging import ship


def in_lines(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Per document the first chained line whose joined compact text contains a label, with the token it starts in (L2)."""
    lines = layout.chain_lines(tokens.withColumn("key", text.compact(F.col("text")))).groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "key"))).alias("ts"))
    joined = lines.withColumn("whole", F.array_join(F.transform("ts", lambda t: t["key"]), ""))
    place = F.least(*[F.when(F.locate(x, F.col("whole")) > 0, F.locate(x, F.col("whole"))) for x in labels], F.lit(1 << 30))
    hits = joined.withColumn("place", place).where(F.col("place") < 1 << 30)
    ends = F.aggregate("ts", F.struct(F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("seq")), lambda a, t: F.struct((a["at"] + F.length(t["key"])).alias("at"), F.when(a["seq"].isNull() & (a["at"] + F.length(t["key"]) >= F.col("place")), t["seq"].cast("bigint")).otherwise(a["seq"]).alias("seq")), lambda a: a["seq"])
    return hits.withColumn("seq", ends).groupBy("doc_id").agg(F.min(F.struct("page", "line", "seq")).alias("t")).select("doc_id", "t.page", "t.seq")


def similar(value: str, labels: list[str], ratio: float = 0.9) -> bool:
    """A window of the value (a label's length, one less or one more, at least six) resembles a label."""
    for label in labels:
        n = len(label)
        if n < 6:
            continue
        for size in (n - 1, n, n + 1):
            if size < 6:
                continue
            for i in range(max(0, len(value) - size) + 1):
                part = value[i : i + size]
                if part and part[0] == label[0] and len(part) >= 6 and SequenceMatcher(None, label, part).ratio() >= ratio:
                    return True
    return False


def fuzzy_label(values: DataFrame, labels: list[str], column: str = "text") -> DataFrame:
    """Rows with ``matches``: their compact text resembles a label (L3).

    The ratio is that of longest common blocks, which no built-in function computes; exact hits are told by a
    built-in first, and only the rest goes to Python in Arrow batches.
    """
    ship(values.sparkSession)

    @F.pandas_udf("boolean")
    def resembles(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: similar(k, labels))

    exact = F.lit(False)
    for label in labels:
        exact = exact | F.col("key").contains(label)
    keyed = values.withColumn("key", F.coalesce(text.compact(F.col(column)), F.lit("")))
    return keyed.withColumn("matches", exact | resembles(F.when(exact, F.lit("")).otherwise(F.col("key")))).drop("key")

"""Sinks: spreadsheet CSV, the keyed JSON store, the text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.audit import report
from docspark.sources import store

BOM = "﻿"


def write_csv(cells: DataFrame, path: str) -> None:
    """Semicolon CSV parts with CRLF; each part starts with a byte-order mark and the header (K2).

    The mark is written as part of the first header name, so parts are written in parallel and stand alone.
    """
    names = cells.columns
    marked = cells.toDF(BOM + names[0], *names[1:])
    marked.write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").option("lineSep", "\r\n").csv(path)


def write_json(records: DataFrame, path: str, key: str = "key") -> None:
    """Records as JSON lines ``{key, record}`` that ``files.json_store`` reads again (K1, K5).

    A commit of ``store``: readers see the old records until the new ones stand whole, and a store may be written from its own
    records.
    """
    fields = [c for c in records.columns if c not in (key, "key")]
    lines = records.select(F.col(key).alias("key"), F.struct(*fields).alias("record"))
    store.commit(lines, path, "key", store.newest(records.sparkSession, path), kind="json")


def write_report(audit: DataFrame, path: str) -> None:
    """The audit report as ordered text lines (K3)."""
    report(audit).orderBy("part", "nr").select("line").write.mode("overwrite").text(path)

"""Sources: folders of documents, the keyed JSON store, semicolon CSV."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.flatten import RECORD_SCHEMA
from docspark.sources import documents, store


def document_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", content: bool = True) -> DataFrame:
    """Files under a folder, at any depth: ``doc_id`` (relative path), ``length``, ``content``."""
    every = documents.listed(spark, folder, pattern)
    if not content:
        return every
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    empty = every.where("length = 0").withColumn("content", F.to_binary(F.lit(""), F.lit("utf-8")))
    return files.select(documents.relative("path", folder).alias("doc_id"), "length", "content").unionByName(empty)


def tokens_of(files: DataFrame, read: Callable, fallback: Callable | None = None, engine: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Positioned tokens of files and the files that gave none (S2 to S5), as ``documents.Decoder`` tells.

    Both tables come from one lazy table, which is decoded for each of them; write ``documents.tokens_of`` and filter it to decode once.
    """
    return split_failures(documents.tokens_of(files, documents.Decoder(read, fallback, engine)))


def split_failures(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return decoded.where("motivo is null").drop("motivo"), decoded.where("motivo is not null").select("doc_id", "motivo")


def json_store(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, touched: list[int] | None = None) -> DataFrame:
    """Records of a keyed JSON store (S6, S7); a file that isn't one fails the read.

    The store that ``sinks.write_json`` writes has a line ``{"key": ..., "record": {...}}`` for each record and is read in
    parallel, or only its buckets ``touched``. A single JSON object ``key: record`` is read too, for imports: it is one cell in one task, so it must be small.
    """
    state = store.newest(spark, path)
    if state is not None:
        path = store.folders(path, state, touched)
        if not path:
            return spark.createDataFrame([], f"key string, {schema}")
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    record = f"struct<{_struct(schema)}>"
    if first and re.match(r'\s*\{\s*"(key|record)"\s*:', first[0].value):
        lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", f"key string, record {record}", {"mode": "FAILFAST"}).alias("r"))
        return lines.select("r.key", "r.record.*")
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"map<string, {record}>", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias("key", "record")).select("key", "record.*")


def _struct(ddl: str) -> str:
    """Top-level column definitions of a DDL string as struct members."""
    out, depth, word = [], 0, ""
    for c in " ".join(ddl.split()) + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind.replace(' ', '')}")
            word = ""
        else:
            word += c
    return ",".join(out)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV with a header and perhaps a byte-order mark; all cells are text, short rows are padded."""
    rows = spark.read.option("sep", ";").option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])

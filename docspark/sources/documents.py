"""A folder of documents as a data source of positioned tokens, a stream of the same folder, and what a folder holds.

The decoders are the caller's: ``read`` for embedded text, ``fallback`` for recognition. An engine that ``fallback`` needs is made
when a worker first meets a file without embedded text, and then kept for all files of that worker (S4).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from docspark.packaging import ship

NAME, FILES = "docspark_tokens", "docspark_files"
TOKEN_SCHEMA = "doc_id string, seq int, page int, x double, y double, conf double, text string"
READ_SCHEMA = TOKEN_SCHEMA + ", motivo string"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20

_ENGINES: dict[str, object] = {}


@dataclass(frozen=True)
class Decoder:
    """How bytes become ``page, x, y, conf, text`` rows; None or no rows stand for a file without tokens.

    With ``engine``, a function without parameters, ``fallback`` is called with the bytes and what ``engine`` returned; ``name`` tells
    engines of one worker apart.
    """

    read: Callable | None
    fallback: Callable | None = None
    engine: Callable | None = None
    name: str = ""

    def _made(self) -> object:
        key = self.name or f"{self.engine.__module__}:{self.engine.__qualname__}"
        if key not in _ENGINES:
            _ENGINES[key] = self.engine()
        return _ENGINES[key]

    def rows(self, doc: str, content: Callable[[], bytes]) -> Iterator[tuple]:
        """Rows of ``READ_SCHEMA``: the tokens of a file, or one row that says why there are none. Never raises."""
        why = "no tokens"
        for step in (self.read, self.fallback):
            if step is None:
                continue
            try:
                more = (self._made(),) if step is self.fallback and self.engine else ()
                found = [(doc, i, int(page), float(x), float(y), None if conf is None else float(conf), text, None) for i, (page, x, y, conf, text) in enumerate(step(content(), *more) or ())]
            except Exception as e:  # a broken file is a result, not a failed job
                why = f"{type(e).__name__}: {e}"
                continue
            if found:
                yield from found
                return
        yield (doc, None, None, None, None, None, None, why)


def tokens_of(files: DataFrame, decoder: Decoder) -> DataFrame:
    """Tokens and failures (rows with ``motivo``) of ``doc_id, content``; a batch or a stream."""
    ship(files.sparkSession)
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                out = pd.DataFrame(list(decoder.rows(doc, lambda content=content: bytes(content))), columns=names)
                yield out.astype({"seq": "Int32", "page": "Int32", "x": "float64", "y": "float64", "conf": "float64", "text": object, "motivo": object})

    return files.select("doc_id", "content").mapInPandas(rows, READ_SCHEMA)


def document_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_at_once: int | None = None) -> DataFrame:
    """The files under a folder as a stream of ``doc_id, content``, each file once; pass it to ``tokens_of``.

    Spark's file source keeps the list of files seen in the stream's checkpoint, so a restarted stream goes on where it was. It
    leaves out empty files; the batch sources report them as failures.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    return stream.load(folder).select(relative("path", folder).alias("doc_id"), "content")


def relative(path: str, folder: str) -> F.Column:
    """A file's path below ``folder`` with forward slashes."""
    base = "".join(c if c.isalnum() else f"\\{c}" for c in folder.rstrip("/"))
    return F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), rf"^.*?{base}/", "")


def listed(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``doc_id, length`` of all files under a folder, empty ones too, which Spark's own file sources leave out. No file is opened."""
    register(spark)
    return spark.read.format(FILES).option("pattern", pattern).load(folder)


def folder_status(spark: SparkSession, folder: str, records: DataFrame | None = None, pattern: str = "*.pdf") -> DataFrame:
    """One row: ``files, bytes, keys``, the files under a folder, their size and the keys of the store's records."""
    keys = records.select("key") if records is not None else spark.createDataFrame([], "key string")
    both = listed(spark, folder, pattern).select("length", F.lit(None).alias("key")).unionByName(keys.select(F.lit(None).cast("long").alias("length"), "key"))
    return both.agg(F.count("length").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_distinct("key").alias("keys"))


@dataclass
class Share(InputPartition):
    """Files of one task as (path, relative path, size)."""

    files: tuple[tuple[str, str, int], ...]

    def __post_init__(self) -> None:
        super().__init__(self.files)


def shares(files: Iterable[tuple[str, str, int]], most: int = PARTITION_BYTES, each: int = OPEN_BYTES) -> list[Share]:
    """Files in order of their relative path, cut where a task's bytes, with ``each`` for opening a file, would pass ``most``.

    A larger file is a task of its own.
    """
    out, some, held = [], [], 0
    for path, doc, size in sorted(files, key=lambda f: f[1]):
        if some and held + size + each > most:
            out.append(Share(tuple(some)))
            some, held = [], 0
        some.append((path, doc, size))
        held += size + each
    return [*out, Share(tuple(some))] if some else out


class FileReader(DataSourceReader):
    """Lists the files: paths and sizes meet on the driver, as with Spark's own file sources."""

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        if not self.options.get("path"):
            raise ValueError("the format needs a path to load")

    def _files(self):
        from pyarrow import fs

        where = self.options["path"]
        if "://" in where or where.startswith("file:"):
            return fs.FileSystem.from_uri(where)
        return fs.LocalFileSystem(), where

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        system, base = self._files()
        base, pattern = base.rstrip("/"), self.options.get("pattern", "*.pdf")
        found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and fnmatch(f.base_name, pattern)]
        return shares([(f.path, f.path[len(base) + 1 :], f.size) for f in found], int(self.options.get("partitionbytes", PARTITION_BYTES))) or [Share(())]

    def read(self, partition: Share) -> Iterator[tuple]:
        for _, doc, size in partition.files:
            yield doc, size


class TokenReader(FileReader):
    """Reads and decodes the files of a task, one at a time."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not self.options.get("reader"):
            raise ValueError(f"{NAME} needs the option reader, as module:function")

    def read(self, partition: Share) -> Iterator[tuple]:
        system, _ = self._files()
        decoder = Decoder(*[self._function(k) for k in ("reader", "fallback", "engine")], self.options.get("engine", ""))

        def opened(path: str) -> bytes:
            with system.open_input_stream(path) as f:
                return f.read()

        for path, doc, _ in partition.files:
            yield from decoder.rows(doc, lambda path=path: opened(path))

    def _function(self, option: str) -> Callable | None:
        if not (value := self.options.get(option)):
            return None
        module, name = value.split(":")
        return getattr(importlib.import_module(module), name)


class DocumentFiles(DataSource):
    """``spark.read.format("docspark_files")``: names and sizes of a folder's documents. Options ``pattern``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "doc_id string, length long"

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self.options)


class DocumentTokens(DataSource):
    """``spark.read.format("docspark_tokens")``: a folder's documents as tokens, with a row that has ``motivo`` for a file without any.

    Options, functions as ``module:function``: ``reader``, ``fallback``, ``engine``; ``pattern`` of file names (``*.pdf``); ``partitionBytes`` of a task.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and its workers."""
    ship(spark)
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(DocumentTokens)

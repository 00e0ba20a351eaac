"""A keyed table in a folder that is always whole: immutable files, and a numbered list of those that count.

Rows are dealt to a fixed number of buckets by their key's hash. A commit writes the buckets it touches under a new name, then a list of
all buckets' folders under a name of its own, and last gives that list the next number. Until then readers see the list before, so a
job that ends anywhere leaves a readable table. Two commits of the same number can't both succeed: the second fails.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
KINDS = ("parquet", "json")


@dataclass(frozen=True)
class Generation:
    """One state of a table: the folder of each bucket that has rows, how rows are kept, and what its writer noted."""

    number: int
    buckets: int
    kind: str
    schema: dict
    parts: dict[str, str]
    note: dict = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another commit took the number first; read again and merge anew."""


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key; null keys have one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def newest(spark: SparkSession, path: str) -> Generation | None:
    """The state that readers see; None where nothing was committed."""
    numbers = _numbers(spark, path)
    return _load(spark, path, max(numbers)) if numbers else None


def folders(path: str, state: Generation, touched: list[int] | None = None) -> list[str]:
    """Folders of all buckets, or of some."""
    return [f"{path}/data/{name}/bucket={b}" for b, name in sorted(state.parts.items()) if touched is None or int(b) in touched]


def read(spark: SparkSession, path: str, state: Generation | None = None, touched: list[int] | None = None) -> DataFrame | None:
    """The table, or some of its buckets; None where nothing was committed."""
    state = state or newest(spark, path)
    if state is None:
        return None
    schema, found = StructType.fromJson(state.schema), folders(path, state, touched)
    if not found:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.parquet(*found) if state.kind == "parquet" else reader.option("mode", "FAILFAST").json(found)


def touched_by(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """Buckets that the keys fall into, at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col(key), buckets)).distinct().collect())


def commit(rows: DataFrame, path: str, key: str, before: Generation | None, touched: list[int] | None = None, buckets: int = BUCKETS, kind: str = "parquet", note: dict | None = None) -> Generation:
    """Make ``rows`` the content of the buckets ``touched``, or of the whole table where that is None, after the state ``before``.

    Rows outside the touched buckets are an error of the caller. A table keeps its number of buckets; its kind of files may only
    change when it is written whole.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    spark, name = rows.sparkSession, uuid.uuid4().hex
    if before is not None:
        buckets = before.buckets
        if touched is not None and before.kind != kind:
            raise ValueError(f"the table is kept as {before.kind}")
    dealt = rows.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", F.col("bucket"))  # large buckets are written by several tasks
    writer = dealt.write.partitionBy("bucket")
    writer.parquet(f"{path}/data/{name}") if kind == "parquet" else writer.option("ignoreNullFields", False).json(f"{path}/data/{name}")
    files, where = _files(spark, f"{path}/data/{name}")
    written = {s.getPath().getName().split("=")[1]: name for s in files.listStatus(where) if s.getPath().getName().startswith("bucket=")}
    kept = {} if before is None or touched is None else {b: n for b, n in before.parts.items() if int(b) not in touched}
    if kept.keys() & written.keys():
        raise ValueError("rows outside the touched buckets")
    state = Generation(before.number + 1 if before else 0, buckets, kind, json.loads(rows.schema.json()), kept | written, note or {})
    _publish(spark, path, state)
    return state


def clean(spark: SparkSession, path: str, keep: int = 2, hours: float = 24.0) -> int:
    """Remove folders that none of the newest ``keep`` states names and that are older than ``hours``; returns how many.

    Age protects commits that run now. Readers of an older state fail once its folders are gone.
    """
    numbers = _numbers(spark, path)
    if not numbers:
        return 0
    named = {n for k in numbers[-keep:] for n in _load(spark, path, k).parts.values()}
    files, data = _files(spark, f"{path}/data")
    limit = (time.time() - hours * 3600) * 1000
    old = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in named and s.getModificationTime() <= limit]
    for k in numbers[:-keep]:
        files.delete(_hadoop(spark).Path(_list(path, k)), False)
    for p in old:
        files.delete(p, True)
    return len(old)


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs


def _files(spark: SparkSession, path: str):
    where = _hadoop(spark).Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _list(path: str, number: int) -> str:
    return f"{path}/_states/{number:010d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, where = _files(spark, f"{path}/_states")
    if not files.exists(where):
        return []
    return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in files.listStatus(where)) if n.endswith(".json") and n[:-5].isdigit())


def _load(spark: SparkSession, path: str, number: int) -> Generation:
    files, where = _files(spark, _list(path, number))
    stream = files.open(where)
    try:
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return Generation(**json.loads(bytes(raw).decode()))


def _publish(spark: SparkSession, path: str, state: Generation) -> None:
    fs = _hadoop(spark)
    files, target = _files(spark, _list(path, state.number))
    fresh = fs.Path(f"{path}/_states/_{uuid.uuid4().hex}")
    out = files.create(fresh, False)
    out.write(bytearray(json.dumps(asdict(state)).encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    context = fs.FileContext.getFileContext(files.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fresh, target, plain)  # fails where the name is taken
    except Py4JJavaError as e:
        files.delete(fresh, False)
        if files.exists(target):
            raise Conflict(f"state {state.number} of {path} was committed by another job") from e
        raise

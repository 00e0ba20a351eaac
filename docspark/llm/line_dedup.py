"""Lines that stand in many documents, found with levelled sorted runs of line hashes.

Documents come in batches. A batch's lines become one entry for each key: how many documents hold it and the largest id
among them. Entries that the runs on file settle already are left out by merge anti-joins; the others are written as a run of
their own, bucketed and sorted by key, so that merging a batch moves no run. ``fan`` runs of one level are compacted into one of the next.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import common

BLANKS = " \t\n\x0b\f\r"
KEY = ["hi", "lo"]


def stripped(line: Column) -> Column:
    """The line without ASCII white space at its ends."""
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    """The stripped line with A-Z in lower case; ``lower`` does just that where all characters are ASCII."""
    bare = stripped(line)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


class LineRuns:
    """Runs of ``hi, lo, docs, top`` (a key's hash, its documents, the largest id) in levels under ``path``.

    A run is a bucketed table; tables of one number of buckets merge where they lie. The session's number of shuffle partitions
    is that number, so that a batch's aggregate is dealt as the runs are.
    """

    def __init__(self, spark: SparkSession, path: str, least: int, fan: int = 3):
        self.spark, self.path, self.least, self.fan = spark, path, least, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"docspark_line_run_{uuid.uuid4().hex}"
        entries.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """One entry for each key of some runs. Their files are read as such: a union of bucketed tables would be taken for dealt by key, which it isn't."""
        files = self.spark.read.schema("hi long, lo long, docs long, top long").parquet(*(f"{self.path}/{name}" for name in names))
        return files.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of ``doc_id, hi, lo``; a document belongs to one batch.

        An entry is settled when a run has its key in enough documents and with an id that is as large.
        """
        held = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))  # a document counts once, also where a common line is spread over all tasks
        fresh = held.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
        for run in self.runs():
            settled = run.where(F.col("docs") >= self.least).select(*KEY, F.col("top").alias("known"))
            fresh = fresh.alias("f").join(settled.alias("s"), (F.col("f.hi") == F.col("s.hi")) & (F.col("f.lo") == F.col("s.lo")) & F.coalesce(F.col("known") >= F.col("top"), F.col("top").isNull()), "left_anti")
        self._write(fresh, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one run of the next level."""
        old = self.levels[level]
        if level + 1 == len(self.levels):
            self.levels.append([])
        self._write(self._merged(old), level + 1)
        self.levels[level] = []
        self._drop(old)

    def frequent(self) -> DataFrame:
        """``hi, lo, top`` of keys in at least ``least`` documents, from all runs."""
        return self._merged([name for level in self.levels for name in level]).where(F.col("docs") >= self.least).select(*KEY, "top")

    def close(self) -> None:
        """Take the runs out of the catalog; their files stay."""
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]


def line_entries(rows: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """``doc_id, version, pos, hi, lo, batch`` of every line whose key is long enough; the largest ids are in batch 0, rows without an id in the last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()["cuts"] if batches > 1 else None
    batch = reduce(lambda total, cut: total + (F.col("doc_id") < cut).cast("int"), sorted(set(cuts or [])), F.lit(0))
    lines = rows.select("doc_id", "version", F.coalesce(batch, F.lit(batches - 1)).alias("batch"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long_enough = lines.where(F.char_length(stripped(F.col("line"))) >= min_chars)
    key = line_key(F.col("line"))
    return long_enough.select("doc_id", "version", "pos", F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(7), key).alias("lo"), "batch")


def drop_repeated_lines(docs: DataFrame, least: int = 5, min_chars: int = 40, batches: int = 6, fan: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines that many documents share: ``doc_id, text, n_lines, n_dropped``, one row for each row.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case; keys are told apart by 128 bits of hash.
    A key of at least ``min_chars`` code points in at least ``least`` documents loses all its lines but those in the largest
    document that holds it. Null and empty texts are one empty line. Rows that repeat an id are one document; rows without an id are one
    document too, smaller than all others. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    rows = common.texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    path = f"{common.shared_dir(spark)}/docspark/{uuid.uuid4().hex}"
    entries = line_entries(rows, min_chars, batches)
    entries.write.partitionBy("batch").parquet(f"{path}/line-entries")
    entries = spark.read.schema(entries.schema).parquet(f"{path}/line-entries")
    runs = LineRuns(spark, path, least, fan)
    for batch in range(batches):
        runs.add(entries.where(F.col("batch") == batch).select("doc_id", *KEY))
    frequent = common.stored(runs.frequent(), "frequent-lines")
    runs.close()

    lost = common.keyed_join(entries.drop("batch"), frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    lost = lost.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "lost")
    split = rows.select("doc_id", "version", F.split("text", "\n").alias("lines"))
    met = split.join(lost, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    return met.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     t AS (SELECT doc_id, r, unnest(range(len(l))) AS pos, unnest(l) AS line FROM d),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM t),
     f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> f.top AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r
"""

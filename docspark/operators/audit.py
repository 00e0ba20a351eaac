"""Audit of normalised values: status per cell, counts, anomalies, type assertion."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import numbers
from docspark.staging import stored

LOGGED_FIELDS = ("valor_da_nota", "peso_bruto", "peso_liquido")


def audit_cells(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each text cell: ``seq, archivo, campo, crudo, valor, estado, motivo``.

    ``cells`` has ``seq``, ``archivo`` and the raw fields as columns.
    """
    judged = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("crudo"), numbers.field_status(F.col(f), f).alias("r")) for f in fields])
    return cells.select("seq", "archivo", F.posexplode(judged).alias("nr", "a")).select("seq", "archivo", "nr", "a.campo", "a.crudo", "a.r.valor", "a.r.estado", "a.r.motivo")


def status_counts(audit: DataFrame) -> DataFrame:
    """Rows for each status, all seven, zeros too (A3)."""
    spark: SparkSession = audit.sparkSession
    every = spark.createDataFrame([(i, s) for i, s in enumerate(numbers.STATUSES)], "nr int, estado string")
    return every.join(audit.groupBy("estado").agg(F.count("*").alias("n")), "estado", "left").select("nr", "estado", F.coalesce("n", F.lit(0)).alias("n"))


def status_matrix(audit: DataFrame) -> DataFrame:
    """Rows for each field and status (A4)."""
    return audit.groupBy("campo", "estado").agg(F.count("*").alias("n"))


def anomalies(audit: DataFrame) -> DataFrame:
    """Cells to review, numbered by file and then order.

    Numbers are the place within the file plus what earlier files hold. Files stand in range partitions by name: a file's start is what
    its partition held before it plus what earlier partitions hold, one number for each partition. No task sorts all anomalies
    or all files.
    """
    found = audit.where(F.col("estado").isin(*numbers.TO_REVIEW))
    inside = found.withColumn("k", F.row_number().over(Window.partitionBy("archivo").orderBy("seq", "nr", "crudo")))
    per_file = found.groupBy("archivo").agg(F.count("*").alias("n"))
    ranged = stored(per_file.repartitionByRange("archivo").withColumn("part", F.spark_partition_id()), "files")
    held = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each range partition
    starts = itertools.accumulate((r.n for r in held), initial=0)
    earlier = audit.sparkSession.createDataFrame([(r.part, start) for r, start in zip(held, starts, strict=False)], "part int, earlier bigint")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("archivo")) - F.col("n")
    before = ranged.withColumn("running", running).join(F.broadcast(earlier), "part").select(F.col("archivo").alias("_file"), (F.col("running") + F.col("earlier")).alias("before"))
    placed = inside.join(before, F.col("archivo").eqNullSafe(F.col("_file")))
    return placed.select((F.col("before") + F.col("k")).alias("nr"), "archivo", "seq", "campo", "crudo", "estado")


def type_errors(cells: DataFrame, fields: list[str]) -> DataFrame:
    """Cells of numeric fields that hold something but no plain number."""
    each = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("raw")) for f in fields])
    return cells.select(F.explode(each).alias("c")).groupBy("c.campo").agg(F.count("*").alias("checked"), F.count_if((F.col("c.raw") != "") & F.col("c.raw").try_cast("double").isNull()).alias("errors"))


def by_file(audit: DataFrame) -> DataFrame:
    """Per file its cells, those that are fine, and those to review by field: ``archivo, celdas, bien, revisar``."""
    review = F.col("estado").isin(*numbers.TO_REVIEW)
    fields = audit.groupBy("archivo", "campo").agg(F.count("*").alias("n"), F.count_if(F.col("estado").isin("ok", "limpio")).alias("fine"), F.count_if(review).alias("bad"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bad") > 0, F.struct("campo", "bad")))), lambda x: F.concat_ws(" ", x["campo"], x["bad"])), ", ")
    return fields.groupBy("archivo").agg(F.sum("n").alias("celdas"), F.sum("fine").alias("bien"), named.alias("revisar"))


def report(audit: DataFrame) -> DataFrame:
    """The text report as ordered lines (K3): counts, the matrix of fields and statuses, numbered anomalies, detail by file."""
    head = status_counts(audit).select(F.lit(0).alias("part"), F.col("nr").cast("long").alias("nr"), F.concat_ws(": ", "estado", "n").alias("line"))
    body = anomalies(audit).select(F.lit(1).alias("part"), F.col("nr").cast("long").alias("nr"), F.concat_ws(" | ", F.col("nr"), "archivo", "campo", F.coalesce("crudo", F.lit("")), "estado").alias("line"))
    matrix = status_matrix(audit).select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("campo", "estado")).cast("long").alias("nr"), F.concat_ws(" | ", "campo", "estado", "n").alias("line"))
    files = by_file(audit).select(F.lit(3).alias("part"), F.xxhash64("archivo").alias("nr"), F.concat_ws(" | ", "archivo", "celdas", "bien", "revisar").alias("line"))
    return head.unionByName(matrix).unionByName(body.withColumn("part", F.lit(2))).unionByName(files)


def extraction_log(records: DataFrame, failed: DataFrame) -> DataFrame:
    """What there is to know of each file, as ``arquivo, nr, nivel, mensaje``.

    An error for a file without tokens (``doc_id, motivo``). For a record: its number of items and its status; a warning for each weight
    or value that wasn't found, for a key that isn't valid and for each item without a description. Null files and null items
    count like others.
    """
    line = lambda level, *message: F.struct(F.lit(level).alias("nivel"), F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message]).alias("mensaje"))
    items = F.coalesce("produtos", F.array())
    known = [line("INFO", "produtos: ", F.size(items).cast("string")), line("INFO", "status: ", F.coalesce("status_extracao", F.lit("")))]
    missing = [F.when(F.col(c).isNull(), line("WARNING", f"{c}: no encontrado")) for c in LOGGED_FIELDS]
    key = F.when(~F.coalesce("chave_valida", F.lit(False)), line("WARNING", "chave_de_acesso: no valida"))
    bare = F.transform(items, lambda p, i: F.when(F.trim(F.coalesce(p["descricao"], F.lit(""))) == "", line("WARNING", "produtos: item ", (i + 1).cast("string"), " sin descripcion")))
    own = records.select("arquivo", F.posexplode(F.array_compact(F.concat(F.array(*known, *missing, key), bare))).alias("nr", "l")).select("arquivo", "nr", "l.*")
    return own.unionByName(failed.select(F.col("doc_id").alias("arquivo"), F.lit(0).alias("nr"), F.lit("ERROR").alias("nivel"), F.col("motivo").alias("mensaje")))

"""From a folder of documents to the keyed store, the spreadsheet and the report, in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import audit as audits, flatten, merge, notes
from docspark.sources import documents, files, sinks, store


def unread(found: DataFrame, path: str) -> DataFrame:
    """Files that no record of the store under ``path`` names."""
    if store.newest(found.sparkSession, path) is None:
        return found
    known = files.json_store(found.sparkSession, path, "arquivo string").select(F.col("arquivo").alias("doc_id"))
    return found.join(known, "doc_id", "left_anti")


def merge_into(new: DataFrame, path: str, merged: str, mode: str = "fill") -> DataFrame:
    """Commit records with ``key`` and ``arquivo`` to the store under ``path``; the touched buckets' rows with their ``state`` stay at ``merged``.

    Records of one key count in the order of their files, after what the store has.
    """
    spark, state = new.sparkSession, store.newest(new.sparkSession, path)
    touched = None if state is None else store.touched_by(new, "key", state.buckets)
    before = new.limit(0) if state is None else files.json_store(spark, path, touched=touched).select(*new.columns)
    versioned = lambda rows, n: rows.withColumn("version", F.struct(F.lit(n).alias("n"), "arquivo"))
    merge.upsert(versioned(before, 1), versioned(new, 2), mode).write.mode("overwrite").parquet(merged)
    done, fields = spark.read.parquet(merged), [c for c in new.columns if c != "key"]
    store.commit(done.select("key", F.struct(*fields).alias("record")), path, "key", state, touched, kind="json")
    return done


def extract(
    spark: SparkSession, folder: str, out: str, read: Callable[[bytes], list | None], fallback: Callable | None = None, pattern: str = "*.pdf",
    mode: str = "fill", columns: list[str] | None = None, with_text: bool = False, engine: Callable | None = None,
) -> dict[str, int]:
    """Read all documents of a folder into the store under ``out`` and count what happened (A1, A2, K6).

    ``read``, ``fallback`` and ``engine`` are those of ``documents.Decoder``. Tokens and failures are written first, as one Parquet
    table under ``out``, so files are decoded once. Records are keyed by their key where it is valid, else by file. ``mode`` is one of
    ``merge.MODES``: what the store has for a key is filled up, replaced, or left as it is; with ``only-new`` files that the store names
    aren't read again. Only the store's buckets that a key falls into are read and written. ``columns`` and ``with_text`` are those of the
    spreadsheet. Written: ``decoded``, ``sections``, ``raw``, ``audit``, ``records``, ``merged``, ``store``, ``csv``, ``report``, ``log``.
    """
    if mode not in merge.MODES:
        raise ValueError(f"mode is one of {', '.join(merge.MODES)}")
    path, found = f"{out}/store", files.document_files(spark, folder, pattern)
    if mode == "only-new":
        found = unread(found, path)
    documents.tokens_of(found, documents.Decoder(read, fallback, engine)).write.mode("overwrite").parquet(f"{out}/decoded")
    tokens, failed = files.split_failures(spark.read.parquet(f"{out}/decoded"))
    notes.sections(tokens).write.mode("overwrite").parquet(f"{out}/sections")
    notes.assemble(tokens, spark.read.parquet(f"{out}/sections")).write.mode("overwrite").parquet(f"{out}/raw")
    typed, audit = notes.finish(spark.read.parquet(f"{out}/raw"))
    audit.write.mode("overwrite").parquet(f"{out}/audit")
    typed = typed.withColumn("key", F.when(F.col("chave_valida"), F.col("chave_de_acesso")).otherwise(F.col("arquivo")))
    typed.write.mode("overwrite").parquet(f"{out}/records")
    new = spark.read.parquet(f"{out}/records")
    merged = merge_into(new, path, f"{out}/merged", mode)
    whole = files.json_store(spark, path)
    sinks.write_csv(flatten.to_cells(whole, columns, with_text), f"{out}/csv")
    sinks.write_report(spark.read.parquet(f"{out}/audit").withColumn("seq", F.col("nr")), f"{out}/report")
    audits.extraction_log(new, failed).repartitionByRange("arquivo").sortWithinPartitions("arquivo", "nr").write.mode("overwrite").parquet(f"{out}/log")
    n = new.agg(F.count("*").alias("records"), F.count_if(F.col("status_extracao") == "parcial").alias("partial"), F.count_if(~F.coalesce("chave_valida", F.lit(False))).alias("invalid_keys"), F.coalesce(F.sum(F.size("produtos")), F.lit(0)).alias("items")).first().asDict()
    states = merged.agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("inserted", "updated", "unchanged")]).first().asDict()
    return n | {"failed": failed.count(), "stored": whole.count()} | states

"""A stream of record versions merged into a keyed table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators import merge
from docspark.sources import store


def merge_stream(versions: DataFrame, path: str, checkpoint: str, key: str = "key", version: str = "version", buckets: int = store.BUCKETS) -> StreamingQuery:
    """Fill-only merge of a stream into a committed table under ``path`` (J2 over ``foreachBatch``).

    A batch is a commit of ``store`` that notes its number, so a repeated batch changes nothing. Only the buckets that its keys fall
    into are read and written; files that no recent state names go after a day. A row keeps for each field its value together with
    the version that filled it (and, while none has, the first version's own), so the result doesn't depend on how rows
    fall into batches. ``latest`` gives the plain table.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        before = store.newest(spark, path)
        if before is not None and before.note["batch"] >= batch_id:
            return
        fields = [c for c in batch.columns if c not in (key, version)]
        kinds = merge.kinds_of(batch)
        rows = batch.select(key, F.col(version).alias("_first"), *[F.struct(F.when(~merge.is_empty(F.col(c), kinds[c]), F.col(version)).alias("at"), F.col(version).alias("seen"), F.col(c).alias("value")).alias(c) for c in fields])
        touched = None if before is None else store.touched_by(rows, key, before.buckets)
        rows = rows if before is None else store.read(spark, path, before, touched).unionByName(rows)
        # A filled value goes before any blank one, an earlier version before a later one.
        kept = rows.groupBy(key).agg(F.min("_first").alias("_first"), *[F.min_by(c, F.struct(F.col(c)["at"].isNull(), F.coalesce(F.col(c)["at"], F.col(c)["seen"]))).alias(c) for c in fields])
        store.commit(kept, path, key, before, touched, buckets, note={"batch": batch_id})
        store.clean(spark, path)
        batch.unpersist()

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, version: str = "version") -> DataFrame | None:
    """The merged table of the newest state, with the first version of each key; None if there is none."""
    found = store.read(spark, path)
    if found is None:
        return None
    return found.select(*[F.col("_first").alias(version) if c == "_first" else F.col(c)["value"].alias(c) if kind.startswith("struct<at:") else F.col(c) for c, kind in found.dtypes])

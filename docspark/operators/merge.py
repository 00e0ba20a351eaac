"""Keyed upserts of record versions: fill-only, replace, new keys only, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from docspark.functions.cells import is_empty


def first_filled(value: Column, version: Column, kind: str = "string") -> Column:
    """The earliest version's value that isn't empty; the first version's own when all are."""
    return F.coalesce(F.min_by(F.when(~is_empty(value, kind), value), F.when(~is_empty(value, kind), version)), F.min_by(value, version))


def kinds_of(rows: DataFrame) -> dict[str, str]:
    """How emptiness is judged for each column."""
    return {f.name: _kind(f.dataType) for f in rows.schema}


def _kind(of: DataType) -> str:
    return "string" if isinstance(of, StringType) else "array" if isinstance(of, ArrayType) else "other"


def _filled(value: Column, of: DataType, version: Column) -> Column:
    """A field's first filled value; the fields of a struct each for themselves, at any depth."""
    if not isinstance(of, StructType):
        return first_filled(value, version, _kind(of))
    inner = F.struct(*[_filled(value[f.name], f.dataType, version).alias(f.name) for f in of])
    return F.when(F.max(value.isNotNull()), inner)


def fill_only(versions: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """One row for each key: every field from the earliest version that fills it, nested fields each for themselves.

    Arrays of structs are merged place by place in the same way, and the longest one's tail stays; other arrays are taken whole. First-filled is
    associative, so all are grouped aggregates that combine before the shuffle; no key's versions meet in one list.
    """
    lists = [f for f in versions.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    plain = [f for f in versions.schema if f.name not in (key, version) and f not in lists]
    v = F.col(version)
    merged = versions.groupBy(key).agg(*[_filled(F.col(f.name), f.dataType, v).alias(f.name) for f in plain], *[F.max(F.col(f.name).isNotNull()).alias(f"_has_{f.name}") for f in lists])
    for f in lists:
        each = versions.select(key, version, F.posexplode(f.name).alias("_at", "_item"))
        items = each.groupBy(key, "_at").agg(_filled(F.col("_item"), f.dataType.elementType, v).alias("_item"))
        again = items.groupBy(F.col(key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias(f.name))
        none = F.when(F.col(f"_has_{f.name}"), F.array().cast(f.dataType))
        merged = merged.join(again, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(f.name, F.coalesce(f.name, none)).drop("_key", f"_has_{f.name}")
    return merged.select(key, *[c for c in versions.columns if c not in (key, version)])


def merge_items(old: Column, new: Column, fields: list[str]) -> Column:
    """Arrays merged by position: fields of the old item where filled, the longer tail kept."""
    none = F.lit(None)

    def one(a: Column, b: Column) -> Column:
        kept = F.struct(*[F.when(is_empty(a[f].cast("string")), b[f]).otherwise(a[f]).alias(f) for f in fields])
        return F.when(a.isNull(), F.struct(*[b[f].alias(f) for f in fields])).when(b.isNull(), F.struct(*[a[f].alias(f) for f in fields])).otherwise(kept)

    return F.when(old.isNull() & new.isNull(), none).otherwise(F.zip_with(F.coalesce(old, F.filter(new, lambda _: F.lit(False))), F.coalesce(new, F.filter(old, lambda _: F.lit(False))), one))


def replace(versions: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The latest version of each key."""
    fields = [c for c in versions.columns if c != key]
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("v"))
    return latest.select(key, *[F.col("v")[c].alias(c) for c in fields])


MODES = ("fill", "replace", "only-new")


def upsert(existing: DataFrame, incoming: DataFrame, mode: str = "fill", key: str = "key", version: str = "version") -> DataFrame:
    """One row for each key and what happened to it: ``key``, all fields, ``state``.

    ``fill`` fills up what the existing row lacks, ``replace`` takes the latest incoming row, ``only-new`` leaves existing keys as they
    are. States: ``inserted``, ``updated``, ``unchanged`` (incoming changed nothing), ``kept`` (nothing incoming). Both tables have the
    same columns, and existing versions come before incoming ones. Existing rows carry a digest of themselves through the aggregate,
    so states cost no second join.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    fields = [c for c in existing.columns if c not in (key, version)]
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    none = F.lit(None)
    rows = existing.withColumns({"_was": digest, "_met": none.cast("string")}).unionByName(incoming.select(*existing.columns).withColumns({"_was": none.cast("string"), "_met": F.lit("x")}))
    if mode == "fill":
        merged = fill_only(rows, key, version)
    else:
        end = F.max_by if mode == "replace" else F.min_by
        whole = rows.groupBy(key).agg(end(F.struct(*fields), version).alias("v"), F.max("_was").alias("_was"), F.max("_met").alias("_met"))
        merged = whole.select(key, "_was", "_met", *[F.col("v")[c].alias(c) for c in fields])
    state = F.when(F.col("_was").isNull(), "inserted").when(F.col("_met").isNull(), "kept").when(F.col("_was") == digest, "unchanged").otherwise("updated")
    return merged.select(key, *fields, state.alias("state"))


def only_new(incoming: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key doesn't exist yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def changes(existing: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Each key as inserted, changed, unchanged or kept, by null-safe equality of all fields."""
    fields = [c for c in existing.columns if c != key]
    a = existing.select(key, F.struct(*fields).alias("old"))
    b = incoming.select(key, F.struct(*fields).alias("new"))
    state = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))

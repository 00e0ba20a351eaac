"""Command line: ``python -m docspark extract|csv|normalise|validate|summary|status``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docspark.extract import extract
from docspark.operators import flatten, merge, normalise
from docspark.operators.flatten import RECORD_SCHEMA
from docspark.sources import documents, files, sinks

MOST_LINES = 1000  # errors that are printed; all are counted


def validate(spark: SparkSession, path: str) -> int:
    """Prints the cells of numeric fields that hold something but no number; 1 if there is any, else 0."""
    store = files.json_store(spark, path, RECORD_SCHEMA.replace("double", "string"))
    wrong = lambda c: (F.trim(c) != "") & c.try_cast("double").isNull()
    cell = lambda level, f, c: F.when(wrong(c), F.concat_ws(" ", F.concat_ws(".", F.lit(level), F.lit(f)), F.lit("="), c))
    own = F.array(*[cell("nota", f, F.col(f)) for f in normalise.RECORD_FIELDS])
    items = F.flatten(F.transform(F.coalesce("produtos", F.array()), lambda p: F.array(*[cell("prod", f, p[f]) for f in normalise.ITEM_FIELDS])))
    judged = store.select("arquivo", F.size(F.coalesce("produtos", F.array())).alias("items"), F.array_compact(F.concat(own, items)).alias("bad"))
    n = judged.agg(F.count("*").alias("records"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.size("bad")), F.lit(0)).alias("errors")).first()
    print(", ".join(f"{k}: {v}" for k, v in n.asDict().items()))
    for r in judged.select("arquivo", F.explode("bad").alias("cell")).orderBy("arquivo", "cell").limit(MOST_LINES).collect():
        print(f"  - {r.arquivo} {r.cell}")
    return 1 if n.errors else 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docspark", description=__doc__)
    p.add_argument("action", choices=("extract", "csv", "normalise", "validate", "summary", "status"))
    p.add_argument("--json", help="keyed JSON store to read")
    p.add_argument("--folder", help="folder of documents to extract")
    p.add_argument("--reader", help="module:function that turns a file's bytes into page, x, y, conf, text rows")
    p.add_argument("--fallback", help="module:function for files in which the reader finds nothing")
    p.add_argument("--engine", help="module:function that makes, once a worker, what the fallback gets beside the bytes")
    p.add_argument("--out", help="folder to write to")
    p.add_argument("--columns", help="comma-separated columns; all by default")
    p.add_argument("--with-text", action="store_true", help="add the recognised text as a column")
    p.add_argument("--mode", choices=merge.MODES, default="fill", help="what extract does with keys that the store has")
    o = p.parse_args(args)
    if o.action in ("extract", "csv", "normalise") and not o.out:
        p.error(f"{o.action} needs --out")
    if o.action == "extract" and not (o.folder and o.reader) or o.action != "extract" and not o.json:
        p.error("extract needs --folder and --reader, the others --json")
    if o.action == "status" and not o.folder:
        p.error("status needs --folder and --json")
    spark = SparkSession.builder.appName("docspark").getOrCreate()
    if o.action == "extract":
        function = lambda named: getattr(importlib.import_module(named.split(":")[0]), named.split(":")[1]) if named else None
        n = extract(spark, o.folder, o.out, function(o.reader), function(o.fallback), mode=o.mode, columns=o.columns.split(",") if o.columns else None, with_text=o.with_text, engine=function(o.engine))
        print(", ".join(f"{k}: {v}" for k, v in n.items()))
        return 0
    if o.action == "validate":
        return validate(spark, o.json)
    store = files.json_store(spark, o.json)
    if o.action == "status":
        n = documents.folder_status(spark, o.folder, store).first()
        print(", ".join(f"{k}: {v}" for k, v in n.asDict().items()))
    elif o.action == "csv":
        sinks.write_csv(flatten.to_cells(store, o.columns.split(",") if o.columns else None, o.with_text), o.out)
    elif o.action == "normalise":
        raw = store.withColumns({f: F.col(f).cast("string") for f in normalise.RECORD_FIELDS} | {"produtos": F.transform("produtos", lambda x: F.struct(*[x[f].cast("string").alias(f) for f in (*normalise.TEXT_FIELDS, *normalise.ITEM_FIELDS)]))})
        typed, audit = normalise.normalise(raw)
        sinks.write_json(typed, f"{o.out}/records")
        sinks.write_report(audit.withColumn("seq", F.col("nr")), f"{o.out}/report")
    else:
        n = store.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size("produtos")), F.lit(0)).alias("items"), F.count_if(~F.coalesce(F.col("chave_valida"), F.lit(False))).alias("invalid_keys"), F.count_if(F.col("status_extracao") == "parcial").alias("partial")).first()
        print(", ".join(f"{k}: {v}" for k, v in n.asDict().items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())

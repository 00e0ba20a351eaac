"""Queries over number parsing, statuses and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import cells, numbers
from docspark.operators import audit, tables as rebuilt
from docspark.plans import duck, tables

FIELDS = ["valor_total", "quantidade"]


def parse_br_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    parsed = li.select("l_returnflag", numbers.parse_number(tables.brazilian(F.col("l_extendedprice"))).alias("v"))
    return parsed.groupBy("l_returnflag").agg(F.sum(F.round(F.col("v") * 100).cast("bigint")).alias("cents"), F.count("v").alias("n"))


def parse_us_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    parsed = li.select("l_linestatus", numbers.parse_number(F.format_number("l_extendedprice", 2)).alias("v"))
    return parsed.groupBy("l_linestatus").agg(F.sum(F.round(F.col("v") * 100).cast("bigint")).alias("cents"), F.count("v").alias("n"))


def _two(li: DataFrame) -> F.Column:
    return F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(",0000 kg "), tables.brazilian(F.col("l_extendedprice")), F.lit(" / "), F.col("l_linenumber").cast("string"))


def parse_multi_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(numbers.parse_number(_two(li)), 2).alias("valor"))


def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(numbers.first_number(_two(li)), 2).alias("valor"))


def field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit.audit_cells(tables.dirty_prices(spark, sf_dir), FIELDS)
    return a.select("seq", "campo", F.round("valor", 2).alias("valor"), "estado")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(audit.audit_cells(tables.dirty_prices(spark, sf_dir), FIELDS))


def field_status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_matrix(audit.audit_cells(tables.dirty_prices(spark, sf_dir), FIELDS))


def anomaly_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.anomalies(audit.audit_cells(tables.dirty_prices(spark, sf_dir), FIELDS))


def type_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.type_errors(tables.dirty_prices(spark, sf_dir), FIELDS)


def quantity_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber")
    unit = F.when(n == 1, F.concat(F.lit("TON "), q, F.lit(",0000"))).otherwise(F.lit("TON"))
    description = F.when(n == 2, F.concat(F.lit("calcario Qtde: "), q, F.lit(",00"))).otherwise(F.lit("calcario"))
    price = F.when(n == 3, F.concat(q, F.lit(",0000 5.907,0600"))).otherwise(F.lit("10,00"))
    r = numbers.recover_quantity(F.when(n == 4, F.col("l_quantity")), unit, description, price)
    return li.select("l_orderkey", "l_linenumber", r.alias("r"), numbers.strip_unit_number(unit).alias("unidade")).select("l_orderkey", "l_linenumber", "r.quantidade", "r.origen", "unidade")


def ambiguous_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    token = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(",125")).otherwise(F.lit(".342.4")))
    r = numbers.readings(token)
    return li.select("l_orderkey", "l_linenumber", F.size(r).alias("n"), F.round(F.array_min(r), 3).alias("low"), F.round(F.array_max(r), 3).alias("high"))


def litres_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    unit = F.when(F.col("l_linenumber") % 3 == 0, F.lit("TON")).otherwise(F.lit("LT"))
    quantity = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(",500"))
    total = F.col("l_quantity").cast("bigint") + 0.5
    item = F.struct(unit.alias("unidade"), quantity.alias("quantidade"), F.lit("2,00").alias("valor_unitario"), F.regexp_replace(F.format_number(total * 2, 2), ",", "").alias("valor_total"))
    notes = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("p")))).alias("ps"))
    return notes.select("l_orderkey", rebuilt.litres(F.transform("ps", lambda p: p["p"])).alias("volume_litros"))


def triple_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    q, price = F.col("l_quantity"), (F.col("l_partkey") % 90 + 10) * 1.25
    tokens = F.array(F.concat(q.cast("bigint").cast("string"), F.lit(".000")), tables.brazilian(price), tables.brazilian(q * price), F.lit("18,00"))
    return li.select("l_orderkey", "l_linenumber", rebuilt.triple_solve(tokens).alias("r")).select("l_orderkey", "l_linenumber", F.round("r.quantidade", 3).alias("quantidade"), F.round("r.valor_unitario", 3).alias("valor_unitario"), F.round("r.valor_total", 3).alias("valor_total"))


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", cells.cell(F.col("l_extendedprice"), "double").alias("price"), cells.cell(F.col("l_quantity"), "double").alias("quantity"), cells.cell(F.col("l_linestatus") == "F", "boolean").alias("open"), cells.cell(F.when(F.col("l_linenumber") > 3, F.col("l_returnflag")), "string").alias("flag"))


def literal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 3 == 0, F.lpad(F.col("o_orderkey").cast("string"), 14, "0")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("0"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", cells.literal_guard(code).alias("code"))


_TWO = f"CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',0000 kg ' || {duck.brazilian('l_extendedprice')} || ' / ' || CAST(l_linenumber AS VARCHAR)"


def _status(field: str, top: str) -> str:
    return f"""SELECT seq, archivo, {FIELDS.index(field)} AS nr, '{field}' AS campo, {field} AS crudo, v,
        CASE WHEN {field} IS NULL OR trim({field}) = '' THEN 'vacio' WHEN v IS NULL THEN 'no_parseable' WHEN NOT v BETWEEN 0 AND {top} THEN 'fuera_rango'
             WHEN len({duck.tokens(field)}) > 1 THEN 'limpio' ELSE 'ok' END AS estado FROM (SELECT *, {duck.number(field)} AS v FROM dirty)"""


_AUDIT = f"WITH {tables.DIRTY_SQL}, audit AS ({_status('valor_total', '50000000')} UNION ALL {_status('quantidade', '1000000')})"
_STATUS_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(numbers.STATUSES))

ORACLE_SQL = {
    "parse_br_number": f"SELECT l_returnflag, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents, count(v) AS n FROM (SELECT l_returnflag, {duck.number('t')} AS v FROM (SELECT l_returnflag, {duck.brazilian('l_extendedprice')} AS t FROM lineitem)) GROUP BY 1",
    "parse_us_number": f"SELECT l_linestatus, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents, count(v) AS n FROM (SELECT l_linestatus, {duck.number('t')} AS v FROM (SELECT l_linestatus, format('{{:,.2f}}', l_extendedprice) AS t FROM lineitem)) GROUP BY 1",
    "parse_multi_token": f"SELECT l_orderkey, l_linenumber, round({duck.number('t')}, 2) AS valor FROM (SELECT *, {_TWO} AS t FROM lineitem)",
    "first_number": f"SELECT l_orderkey, l_linenumber, round({duck.first('t')}, 2) AS valor FROM (SELECT *, {_TWO} AS t FROM lineitem)",
    "field_status": f"{_AUDIT} SELECT seq, campo, CASE WHEN estado IN ('ok', 'limpio') THEN round(v, 2) END AS valor, estado FROM audit",
    "status_counts": f"{_AUDIT} SELECT s.nr, s.estado, count(a.estado) AS n FROM (VALUES {_STATUS_ROWS}) s(nr, estado) LEFT JOIN audit a ON a.estado = s.estado GROUP BY 1, 2",
    "field_status_matrix": f"{_AUDIT} SELECT campo, estado, count(*) AS n FROM audit GROUP BY 1, 2",
    "anomaly_list": f"{_AUDIT} SELECT row_number() OVER (ORDER BY archivo, seq, nr, crudo) AS nr, archivo, seq, campo, crudo, estado FROM audit WHERE estado IN ('no_parseable', 'fuera_rango', 'recuperado', 'reubicado')",
    "type_assertion": f"""WITH {tables.DIRTY_SQL} SELECT 'valor_total' AS campo, count(*) AS checked, count(*) FILTER (valor_total <> '' AND TRY_CAST(valor_total AS DOUBLE) IS NULL) AS errors FROM dirty
        UNION ALL SELECT 'quantidade', count(*), count(*) FILTER (quantidade <> '' AND TRY_CAST(quantidade AS DOUBLE) IS NULL) FROM dirty""",
    "quantity_recovery": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3, 4) THEN l_quantity END AS quantidade,
        CASE l_linenumber WHEN 1 THEN 'unidade' WHEN 2 THEN 'descricao' WHEN 3 THEN 'valor_unitario' END AS origen, 'TON' AS unidade FROM lineitem""",
    "ambiguous_readings": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 0.125 ELSE round(l_quantity * 1000 + 342.4, 3) END AS low, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 1000 + 125 ELSE round(l_quantity * 1000 + 342.4, 3) END AS high FROM lineitem",
    "litres_sum": "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linenumber % 3 <> 0) > 0 THEN sum(l_quantity + 0.5) FILTER (l_linenumber % 3 <> 0) END AS volume_litros FROM lineitem GROUP BY 1",
    "csv_cells": """SELECT l_orderkey, l_linenumber, replace(regexp_replace(CAST(l_extendedprice AS VARCHAR), '[.]0$', ''), '.', ',') AS price,
        CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CASE WHEN l_linestatus = 'F' THEN 'SI' ELSE 'NAO' END AS open, CASE WHEN l_linenumber > 3 THEN l_returnflag ELSE '' END AS flag FROM lineitem""",
    "literal_guard": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '="' || lpad(CAST(o_orderkey AS VARCHAR), 14, '0') || '"' WHEN 1 THEN '="0' || CAST(o_custkey AS VARCHAR) || '"' ELSE CAST(o_orderkey AS VARCHAR) END AS code FROM orders""",
    "triple_solve": """SELECT l_orderkey, l_linenumber, l_quantity AS quantidade, (l_partkey % 90 + 10) * 1.25::DOUBLE AS valor_unitario, round(l_quantity * (l_partkey % 90 + 10) * 1.25::DOUBLE, 3) AS valor_total FROM lineitem""",
}
QUERIES = {f.__name__: f for f in (parse_br_number, parse_us_number, parse_multi_token, first_number, field_status, status_counts, field_status_matrix, anomaly_list, type_assertion, quantity_recovery, ambiguous_readings, litres_sum, triple_solve, csv_cells, literal_guard)}

"""Test tables as inputs of the operators: printed prices, dirty cells, tokens, keys, nested records.

Every view is derived from whole tables; the SQL twins build the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in as many tasks as shuffles have.

    A table of few bytes is read in one task, and its shuffles are joined into few; here each row takes long or becomes many tokens.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def brazilian(value: Column, places: int = 2) -> Column:
    """A number as printed in Brazil: 1.346,59."""
    return F.translate(F.format_number(value, places), ",.", ".,")


def dirty_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a price cell that is often unclean: ``seq, archivo, valor_total, quantidade``."""
    li = read(spark, sf_dir, "lineitem")
    price, kind = brazilian(F.col("l_extendedprice")), F.pmod(F.col("l_orderkey") * 3 + F.col("l_linenumber"), F.lit(8))
    cell = (
        F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("sem valor")).when(kind == 2, F.lit("0,0017,000,00")).when(kind == 3, F.concat(F.lit("1 "), price))
        .when(kind == 4, F.concat(price, F.lit("0.000.000,00"))).when(kind == 5, F.concat(F.lit("R$ "), price)).otherwise(price)
    )
    quantity = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(",0000")))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("file-"), F.pmod("l_suppkey", F.lit(50)).cast("string")).alias("archivo"), cell.alias("valor_total"), quantity.alias("quantidade"))


DIRTY_SQL = r"""
dirty AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'file-' || CAST(l_suppkey % 50 AS VARCHAR) AS archivo,
    CASE (l_orderkey * 3 + l_linenumber) % 8 WHEN 0 THEN '' WHEN 1 THEN 'sem valor' WHEN 2 THEN '0,0017,000,00' WHEN 3 THEN '1 ' || p WHEN 4 THEN p || '0.000.000,00' WHEN 5 THEN 'R$ ' || p ELSE p END AS valor_total,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',0000' END AS quantidade
    FROM (SELECT *, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS p FROM lineitem))"""


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens: a document for each user, places from the event's own numbers."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("doc_id"), i.alias("seq"), (F.pmod(i, F.lit(3)) + 1).cast("int").alias("page"), (F.pmod(i * 131, F.lit(1700)) * 1.0).alias("x"),
        (F.pmod(i * 37, F.lit(2400)) * 1.0).alias("y"), F.when(F.pmod(i, F.lit(5)) == 0, F.col("event_type")).otherwise(F.concat(F.pmod(i * 7919, F.lit(100000)).cast("string"), F.lit(",50"))).alias("text"),
    )


TOKENS_SQL = """
tokens AS (SELECT user_id AS doc_id, event_id AS seq, CAST(event_id % 3 + 1 AS INT) AS page, (event_id * 131 % 1700) * 1.0::DOUBLE AS x, (event_id * 37 % 2400) * 1.0::DOUBLE AS y,
    CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(event_id * 7919 % 100000 AS VARCHAR) || ',50' END AS text FROM events)"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 43-digit base and its key for each order, by the operator under test."""
    o = read(spark, sf_dir, "orders")
    cnpj = F.lpad((F.col("o_custkey") * 7919 + 10_000_000_000).cast("string"), 14, "0")
    number = F.lpad(F.col("o_orderkey").cast("string"), 17, "0")
    return o.select("o_orderkey", cnpj.alias("cnpj"), F.concat(F.lit("352401"), cnpj, F.lit("55"), F.lit("001"), number, F.lit("1")).alias("base"))


KEYS_SQL = """
bases AS (SELECT o_orderkey, lpad(CAST(o_custkey * 7919 + 10000000000 AS VARCHAR), 14, '0') AS cnpj,
    '352401' || lpad(CAST(o_custkey * 7919 + 10000000000 AS VARCHAR), 14, '0') || '55001' || lpad(CAST(o_orderkey AS VARCHAR), 17, '0') || '1' AS base FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two overlapping versions with blanks, each order in one at least: ``key, version, status, priority, total``."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = o.where((k % 3 != 0) | (k % 2 == 1)).select(k.alias("key"), F.lit(1).alias("version"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("total"))
    new = o.where(k % 2 == 0).select(k.alias("key"), F.lit(2).alias("version"), F.col("o_orderstatus").alias("status"), F.concat(F.col("o_orderpriority"), F.lit("*")).alias("priority"), (F.col("o_totalprice") + 1).alias("total"))
    return old.unionByName(new)


VERSIONS_SQL = """
old AS (SELECT o_orderkey AS key, 1 AS version, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 1),
new AS (SELECT o_orderkey AS key, 2 AS version, o_orderstatus AS status, o_orderpriority || '*' AS priority, o_totalprice + 1 AS total FROM orders WHERE o_orderkey % 2 = 0)"""


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as an item array (null without orders)."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    items = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("produtos"))
    return c.join(items, "c_custkey", "left").select("c_custkey", F.struct("c_name", F.struct("c_mktsegment", "c_acctbal").alias("account")).alias("emitente"), "produtos")

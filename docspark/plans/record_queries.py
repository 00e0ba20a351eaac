"""Queries over nested records: flattening, merging, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import cells
from docspark.operators import flatten, merge
from docspark.plans import duck, tables


def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.customer_orders(spark, sf_dir)
    return c.select("c_custkey", F.col("emitente.c_name").alias("name"), F.col("emitente.account.c_mktsegment").alias("segment"), F.coalesce(F.size("produtos"), F.lit(0)).alias("n"))


def flatten_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten.explode_items(tables.customer_orders(spark, sf_dir).where("produtos is not null"))
    return rows.select("c_custkey", "produto_item", F.col("item.o_orderkey").alias("o_orderkey"), F.col("item.o_orderstatus").alias("status"))


def flatten_outer_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten.explode_items(tables.customer_orders(spark, sf_dir))
    return rows.select("c_custkey", "produto_item", F.col("item.o_orderkey").alias("o_orderkey"))


def column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested columns in catalog order, over records built from orders."""
    o = tables.read(spark, sf_dir, "orders")
    asked = ["unknown", "serie", "arquivo", "valor_da_nota"]
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("serie"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("arquivo"), F.col("o_totalprice").alias("valor_da_nota"))
    return rows.select("o_orderkey", *[cells.cell(F.col(c), dict(rows.dtypes)[c]).alias(c) for c in flatten.chosen(asked)])


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    value = lambda i: F.when(k % (i + 3) == 0, F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(None))).otherwise(F.lit("x"))
    r = flatten.completeness(k % 11 != 0, {n: value(i) for i, n in enumerate(flatten.CORE_FIELDS)})
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.status", "r.motivo")


def suspicious_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    items = {"codigo": F.when(n == 1, "A1234567890123456").otherwise("AB12"), "unidade": F.when(n == 2, "TONELADA").otherwise("TON"), "quantidade": F.when(n == 3, "0,0017,000,00").otherwise("1,00"), "valor_total": F.when(n == 4, "1 2").otherwise(tables.brazilian(F.col("l_extendedprice")))}
    return li.select("l_orderkey", "l_linenumber", flatten.suspicious(items).alias("suspicious"), flatten.bad_item(items).alias("bad"))


def upsert_fill_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fill_only(tables.versions(spark, sf_dir))


def upsert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tables.versions(spark, sf_dir)
    return merge.upsert(both.where("version = 1"), both.where("version = 2"))


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.replace(tables.versions(spark, sf_dir))


def only_new_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.versions(spark, sf_dir)
    return merge.only_new(v.where("version = 2").drop("version"), v.where("version = 1"))


def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.versions(spark, sf_dir).select("key", "version", F.trim("status").alias("status"), F.replace("priority", F.lit("*"), F.lit("")).alias("priority"))
    return merge.changes(v.where("version = 1").drop("version"), v.where("version = 2").drop("version"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a merge run (A1, A2)."""
    c = change_detect(spark, sf_dir)
    return c.agg(F.count_if(F.col("state") == "inserted").alias("inserted"), F.count_if(F.col("state").isin("changed", "unchanged")).alias("updated"), F.count_if(F.col("state") != "inserted").alias("keys_before"), F.count("*").alias("keys_after"))


def array_positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("ps"))
    item = lambda p, blank: F.struct(p["l_partkey"].cast("string").alias("codigo"), F.when(blank, F.lit("")).otherwise(p["l_returnflag"]).alias("unidade"))
    old = F.transform(F.slice("ps", 1, 3), lambda p: item(p, p["l_partkey"] % 2 == 0))
    new = F.transform("ps", lambda p: F.struct(F.concat(p["l_partkey"].cast("string"), F.lit("n")).alias("codigo"), F.lit("N").alias("unidade")))
    merged = li.select("l_orderkey", merge.merge_items(old, new, ["codigo", "unidade"]).alias("m"))
    return merged.select("l_orderkey", F.array_join(F.transform("m", lambda p: F.concat_ws(":", p["codigo"], p["unidade"])), ",").alias("items"))


_ITEMS = "SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k, o_orderkey, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey"
_CORE = [f"CASE WHEN o_orderkey % {i + 3} = 0 THEN '{n}' END" for i, n in enumerate(flatten.CORE_FIELDS)]
_CHANGE = f"""WITH {tables.VERSIONS_SQL}, c AS (SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'inserted' WHEN n.key IS NULL THEN 'kept'
    WHEN trim(o.status) IS NOT DISTINCT FROM trim(n.status) AND o.priority IS NOT DISTINCT FROM replace(n.priority, '*', '') THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN new n ON o.key = n.key)"""
ORACLE_SQL = {
    "nested_path": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(count(o_orderkey) AS INT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "flatten_items": f"SELECT c_custkey, CAST(k AS INT) AS produto_item, o_orderkey, o_orderstatus AS status FROM ({_ITEMS})",
    "flatten_outer_empty": f"SELECT c_custkey, CAST(k AS INT) AS produto_item, o_orderkey FROM ({_ITEMS}) UNION ALL SELECT c_custkey, 1, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "column_filter": "SELECT o_orderkey, 'f' || CAST(o_custkey AS VARCHAR) AS arquivo, o_orderpriority AS serie, replace(regexp_replace(CAST(o_totalprice AS VARCHAR), '[.]0$', ''), '.', ',') AS valor_da_nota FROM orders",
    "completeness": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR m <> '' THEN 'parcial' ELSE 'completa' END AS status,
        CASE WHEN o_orderkey % 11 = 0 THEN 'digito verificador invalido' WHEN m <> '' THEN 'campos nucleares ausentes: ' || m END AS motivo FROM (SELECT o_orderkey, concat_ws(', ', {', '.join(_CORE)}) AS m FROM orders)""",
    "suspicious_products": f"""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'A1234567890123456' ELSE 'AB12' END AS codigo, CASE WHEN l_linenumber = 2 THEN 'TONELADA' ELSE 'TON' END AS unidade,
            CASE WHEN l_linenumber = 3 THEN '0,0017,000,00' ELSE '1,00' END AS quantidade, CASE WHEN l_linenumber = 4 THEN '1 2' ELSE {duck.brazilian('l_extendedprice')} END AS valor_total FROM lineitem),
        s AS (SELECT *, contains(trim(codigo), ' ') OR contains(trim(unidade), ' ') OR contains(trim(quantidade), ' ') OR contains(trim(valor_total), ' ') OR length(codigo) > 15 OR length(unidade) > 5 AS suspicious FROM c)
        SELECT l_orderkey, l_linenumber, suspicious, suspicious OR {duck.number('quantidade')} IS NULL OR {duck.number('valor_total')} IS NULL AS bad FROM s""",
    "upsert_fill_only": f"""WITH {tables.VERSIONS_SQL} SELECT coalesce(o.key, n.key) AS key, coalesce(nullif(trim(o.status), ''), n.status, o.status) AS status, coalesce(o.priority, n.priority) AS priority, coalesce(o.total, n.total) AS total FROM old o FULL JOIN new n ON o.key = n.key""",
    "upsert_states": f"""WITH {tables.VERSIONS_SQL}, m AS (SELECT o.key AS had, n.key AS has, coalesce(o.key, n.key) AS key, coalesce(nullif(trim(o.status), ''), n.status, o.status) AS status, coalesce(o.priority, n.priority) AS priority, coalesce(o.total, n.total) AS total,
            o.status AS s, o.priority AS p, o.total AS t FROM old o FULL JOIN new n ON o.key = n.key)
        SELECT key, status, priority, total, CASE WHEN had IS NULL THEN 'inserted' WHEN has IS NULL THEN 'kept' WHEN status IS NOT DISTINCT FROM s AND priority IS NOT DISTINCT FROM p AND total IS NOT DISTINCT FROM t THEN 'unchanged' ELSE 'updated' END AS state FROM m""",
    "upsert_replace": f"WITH {tables.VERSIONS_SQL}, u AS (FROM old UNION ALL FROM new) SELECT key, arg_max(version, version) AS version, max_by({{'s': status}}, version).s AS status, max_by({{'p': priority}}, version).p AS priority, max_by({{'t': total}}, version).t AS total FROM u GROUP BY 1",
    "only_new_anti": f"WITH {tables.VERSIONS_SQL} SELECT key, status, priority, total FROM new WHERE key NOT IN (SELECT key FROM old)",
    "change_detect": f"{_CHANGE} SELECT key, state FROM c",
    "run_metrics": f"{_CHANGE} SELECT count(*) FILTER (state = 'inserted') AS inserted, count(*) FILTER (state IN ('changed', 'unchanged')) AS updated, count(*) FILTER (state <> 'inserted') AS keys_before, count(*) AS keys_after FROM c",
    "array_positional_merge": """WITH p AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem)
        SELECT l_orderkey, string_agg(CASE WHEN k <= 3 THEN CAST(l_partkey AS VARCHAR) || ':' || CASE WHEN l_partkey % 2 = 0 THEN 'N' ELSE l_returnflag END ELSE CAST(l_partkey AS VARCHAR) || 'n:N' END, ',' ORDER BY k) AS items FROM p GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (nested_path, flatten_items, flatten_outer_empty, column_filter, completeness, suspicious_products, upsert_fill_only, upsert_states, upsert_replace, only_new_anti, change_detect, run_metrics, array_positional_merge)}

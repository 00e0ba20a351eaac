"""Queries over access keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import checksum
from docspark.operators import keys
from docspark.plans import duck, tables


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.keys(spark, sf_dir)
    return k.withColumn("key", F.concat("base", checksum.check_digit(F.col("base")).cast("string")))


def dv_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keys(spark, sf_dir).select("o_orderkey", checksum.check_digit(F.col("base")).alias("dv"))


def dv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with every third order's last digit raised by one."""
    k = _keys(spark, sf_dir)
    last = F.when(F.col("o_orderkey") % 3 == 0, (F.substring("key", 44, 1).cast("int") + 1) % 10).otherwise(F.substring("key", 44, 1).cast("int"))
    return k.select("o_orderkey", checksum.is_valid(F.concat("base", last.cast("string"))).alias("valid"))


def window_valid_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keys(spark, sf_dir)
    return k.select("o_orderkey", checksum.valid_window(F.concat(F.lit("9"), "key", F.lit("77"))).alias("key"))


def key_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("o_orderkey", checksum.slices(F.col("key")).alias("s")).select("o_orderkey", "s.*")


def key_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digit of the order number is raised; the issuer is known, so strict repair applies."""
    k = tables.dealt(_keys(spark, sf_dir), "o_orderkey")
    wrong = F.concat(F.substring("key", 1, 30), ((F.substring("key", 31, 1).cast("int") + 1) % 10).cast("string"), F.substring("key", 32, 13))
    return k.select("o_orderkey", checksum.repair(wrong, F.array("cnpj"), "strict").alias("repaired"))


def key_from_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: a labelled key, one without a label, one misread beside its issuer, one misread beside another."""
    k = tables.dealt(_keys(spark, sf_dir), "o_orderkey").withColumn("kind", F.col("o_orderkey") % 4)
    wrong = F.concat(F.substring("key", 1, 30), ((F.substring("key", 31, 1).cast("int") + 1) % 10).cast("string"), F.substring("key", 32, 13))
    shown = F.when(F.col("kind") >= 2, wrong).otherwise(F.col("key"))
    named = F.when(F.col("kind") == 3, F.lit("99999999000199")).otherwise(F.col("cnpj"))
    printed = F.regexp_replace(named, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
    token = lambda seq, x, y, t: F.struct(F.lit(seq).alias("seq"), F.lit(1).alias("page"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), t.alias("text"))
    held = F.array(
        token(1, 900, 40, F.concat(F.lit("CNPJ "), printed)), token(2, 100, 300, F.when(F.col("kind") == 1, "numero").otherwise("CHAVE DE ACESSO")),
        token(3, 100, 340, F.substring("shown", 1, 22)), token(4, 500, 345, F.substring("shown", 23, 22)), token(5, 1200, 700, F.lit("1.234,50")),
    )
    tokens = k.withColumn("shown", shown).select(F.col("o_orderkey").alias("doc_id"), F.inline(held))
    return keys.access_keys(tokens)


_KEYED = f"WITH {tables.KEYS_SQL}, keyed AS (SELECT *, base || CAST({duck.check_digit('base')} AS VARCHAR) AS key FROM bases)"
_VALID = lambda k: f"(CAST({duck.check_digit(f'substr({k}, 1, 43)')} AS VARCHAR) = substr({k}, 44, 1))"
# All single changes: the weighted sum is taken once for a key, and each change shifts it. Input: o_orderkey, cnpj, k.
_REPAIRS = """summed AS MATERIALIZED (SELECT *, list_sum(list_transform(range(0, 43), lambda i: CAST(k[43 - i] AS INT) * (i % 8 + 2))) AS total, CAST(k[44] AS INT) AS last FROM {}),
        changes AS (SELECT o_orderkey, cnpj, k, j, d, last, CASE WHEN j <= 43 THEN total + (d - CAST(k[j] AS INT)) * ((43 - j) % 8 + 2) ELSE total END AS shifted FROM summed, range(1, 45) a(j), range(0, 10) b(d) WHERE d <> CAST(k[j] AS INT)),
        fitting AS (SELECT *, substr(k, 1, CAST(j AS INT) - 1) || CAST(d AS VARCHAR) || substr(k, CAST(j AS INT) + 1, 44) AS cand FROM changes
            WHERE CASE WHEN 11 - shifted % 11 >= 10 THEN 0 ELSE 11 - shifted % 11 END = CASE WHEN j <= 43 THEN last ELSE d END),
        repairs AS (SELECT o_orderkey, arg_min(cand, j * 10 + d) AS cand FROM fitting WHERE substr(cand, 7, 14) = cnpj GROUP BY 1)"""
ORACLE_SQL = {
    "dv_compute": f"WITH {tables.KEYS_SQL} SELECT o_orderkey, CAST({duck.check_digit('base')} AS INT) AS dv FROM bases",
    "dv_validate": f"{_KEYED} SELECT o_orderkey, o_orderkey % 3 <> 0 AS valid FROM keyed",
    "window_valid_key": f"""{_KEYED}, w AS (SELECT o_orderkey, i, substr('9' || key || '77', i, 44) AS k FROM keyed, range(1, 5) r(i) WHERE i <= 4)
        SELECT o_orderkey, arg_min(k, i) FILTER ({_VALID('k')}) AS key FROM w GROUP BY 1""",
    "key_slices": f"{_KEYED} SELECT o_orderkey, substr(key, 7, 14) AS cnpj, substr(key, 21, 2) AS modelo, substr(key, 23, 3) AS serie FROM keyed",
    "key_repair": f"""{_KEYED}, wrong AS (SELECT o_orderkey, cnpj, substr(key, 1, 30) || CAST((CAST(substr(key, 31, 1) AS INT) + 1) % 10 AS VARCHAR) || substr(key, 32, 13) AS k FROM keyed),
        {_REPAIRS.format('wrong')} SELECT w.o_orderkey, r.cand AS repaired FROM wrong w LEFT JOIN repairs r USING (o_orderkey)""",
}
ORACLE_SQL["key_from_tokens"] = f"""{_KEYED}, shown AS (SELECT *, o_orderkey % 4 AS kind, CASE WHEN o_orderkey % 4 >= 2 THEN substr(key, 1, 30) || CAST((CAST(substr(key, 31, 1) AS INT) + 1) % 10 AS VARCHAR) || substr(key, 32, 13) ELSE key END AS k FROM keyed),
        misread AS (SELECT o_orderkey, CASE WHEN kind = 3 THEN '99999999000199' ELSE cnpj END AS cnpj, k FROM shown WHERE kind >= 2), {_REPAIRS.format('misread')}
        SELECT s.o_orderkey AS doc_id, CASE WHEN s.kind < 2 THEN s.k ELSE coalesce(r.cand, s.k) END AS chave, CASE WHEN s.kind < 2 THEN {_VALID('s.k')} ELSE r.cand IS NOT NULL END AS valida FROM shown s LEFT JOIN repairs r USING (o_orderkey)"""
QUERIES = {f.__name__: f for f in (dv_compute, dv_validate, window_valid_key, key_slices, key_repair, key_from_tokens)}

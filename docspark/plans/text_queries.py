"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import fuzzy
from docspark.plans import tables


def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", text.strip_accents(F.col("text")).alias("plain")).select("doc_id", F.sha2("plain", 256).alias("plain"), F.sha2(F.lower("plain"), 256).alias("lower"))


def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.compact(F.col("text")), 256).alias("compact"))


def clean_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    described = F.concat(F.lit(" -"), F.col("p_name"), F.lit("  "), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, " ; Lote 12 x").when(F.col("p_partkey") % 3 == 1, ". B.C 7 OBS").otherwise(" ."))
    return p.select("p_partkey", text.clean_description(described).alias("description"))


def _code() -> F.Column:
    k = F.col("p_partkey")
    return F.when(k % 4 == 0, F.concat(F.lit("PO"), (k % 90 + 10).cast("string"))).when(k % 4 == 1, F.concat(F.lit("ABO"), F.translate((k % 900 + 100).cast("string"), "0158", "OISB"))).when(k % 4 == 2, F.lit("POIS")).otherwise(F.concat(k.cast("string"), F.lit(" x")))


def fix_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.fix_code(_code()).alias("code"), text.clean_code(F.concat(F.lit("P"), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit(" DADOS"))).alias("first"), text.clean_cfop(F.lit("5102 x")).alias("cfop"))


def _glued() -> F.Column:
    k = (F.col("p_partkey") % 9000 + 1000).cast("string")
    return F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("31042090|020|"), k, F.lit("TN"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("AB"), k)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("310420900"), k, F.lit("UN"))).otherwise(F.concat(k, F.lit("/1")))


def split_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_glued(_glued()), "+").alias("parts"))


def classify_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part").select("p_partkey", F.explode(text.split_glued(_glued())).alias("token"))
    return p.select("p_partkey", "token", text.classify(F.col("token")).alias("field"))


def regex_extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    cnpj = F.concat(F.lit("12."), F.substring(k, 1, 3), F.lit("."), F.substring(k, 4, 3), F.lit("/0001-99"))
    line = F.concat(F.lit("cnpj "), cnpj, F.lit(" ou "), cnpj, F.lit(" em 05/03/2024 valor 1."), F.substring(k, 4, 3), F.lit(",50"))
    return c.select("c_custkey", F.array_join(text.distinct_ids(line), "+").alias("ids"), text.extract_or_null(line, text.DATE).alias("date"), text.extract_or_null(line, text.VALUE).alias("value"), text.extract_or_null(line, text.CPF).alias("cpf"))


def place_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.read(spark, sf_dir, "nation")
    glued = F.concat(F.lit("SP"), F.col("n_name"))
    return n.select("n_nationkey", text.state_of(glued).alias("uf"), text.country_of(glued).alias("pais"), text.checked_address(F.when(F.col("n_nationkey") % 2 == 0, F.lit("123-456 7")).otherwise(F.col("n_name")), F.lit("X")).alias("address"), text.operation_nature(F.concat(F.lit("Venda de graos CFOP (x) "), F.col("n_name"))).alias("nature"), text.series_of(F.concat(F.lit("serie 00"), F.col("n_nationkey").cast("string"))).alias("serie"))


def file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.file_size(F.octet_length("text")).alias("size"))


def fuzzy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight labels with an edit made from the part's key; the ratio has no SQL form."""
    k = F.col("p_partkey")
    spelt = F.when(k % 4 == 0, "PESO BRUTO KG").when(k % 4 == 1, "PES0 BRUT0").when(k % 4 == 2, "PESO LIQUIDO").otherwise(F.col("p_name"))
    found = fuzzy.fuzzy_label(tables.read(spark, sf_dir, "part").select("p_partkey", spelt.alias("text")), ["pesobruto"])
    return found.select("p_partkey", "matches")


_ENDS = "least(" + ", ".join(f"CASE WHEN instr(lower(t), '{m}') > 0 THEN instr(lower(t), '{m}') END" for m in text.DESCRIPTION_ENDS) + ", length(t) + 1)"
_GLUED = "CASE p_partkey % 4 WHEN 0 THEN '31042090|020|' || k || 'TN' WHEN 1 THEN 'AB' || k WHEN 2 THEN '310420900' || k || 'UN' ELSE k || '/1' END"
_PARTS = "CASE p_partkey % 4 WHEN 0 THEN ['31042090', '020', k, 'TN'] WHEN 1 THEN ['AB', k] WHEN 2 THEN ['31042090', '0', k, 'UN'] ELSE [k || '/1'] END"
_PART_K = "(SELECT p_partkey, CAST(p_partkey % 9000 + 1000 AS VARCHAR) AS k FROM part)"
_UNITS = ", ".join(f"'{u}'" for u in text.UNITS)
ORACLE_SQL = {
    "strip_accents": "SELECT doc_id, sha256(t) AS plain, sha256(lower(t)) AS lower FROM (SELECT doc_id, strip_accents(translate(text, 'ºª²³¹', 'oa231')) AS t FROM documents)",
    "compact_text": r"SELECT doc_id, sha256(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g')) AS compact FROM documents",
    "clean_description": f"SELECT p_partkey, nullif(trim(substr(t, 1, CAST({_ENDS} AS INT) - 1), ' .,;:-'), '') AS description FROM (SELECT p_partkey, trim(regexp_replace(' -' || p_name || '  ' || p_type || CASE p_partkey % 3 WHEN 0 THEN ' ; Lote 12 x' WHEN 1 THEN '. B.C 7 OBS' ELSE ' .' END, '\\s+', ' ', 'g')) AS t FROM part)",
    "fix_code": """SELECT p_partkey, CASE WHEN regexp_full_match(c, '[A-Za-z]{1,4}[0-9]{2,8}') THEN c WHEN regexp_full_match(c, '[A-Za-z0-9]{2,12}') AND regexp_full_match(m, '[A-Za-z]{1,4}[0-9]{2,8}') THEN m ELSE c END AS code,
        'P' || CAST(p_partkey % 90 + 10 AS VARCHAR) AS first, '5102' AS cfop
        FROM (SELECT p_partkey, c, translate(c, 'OoIilSsBZG', '0011155826') AS m FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'PO' || CAST(p_partkey % 90 + 10 AS VARCHAR)
        WHEN 1 THEN 'ABO' || translate(CAST(p_partkey % 900 + 100 AS VARCHAR), '0158', 'OISB') WHEN 2 THEN 'POIS' ELSE CAST(p_partkey AS VARCHAR) || ' x' END AS c FROM part))""",
    "split_glued": f"SELECT p_partkey, array_to_string({_PARTS}, '+') AS parts FROM {_PART_K}",
    "classify_token": f"""SELECT p_partkey, token, CASE WHEN regexp_full_match(token, '[0-9]{{8}}') THEN 'ncm' WHEN regexp_full_match(token, '[1-7][0-9]{{3}}') THEN 'cfop' WHEN regexp_full_match(token, '[0-9]{{1,3}}/[0-9]{{1,2}}') THEN 'origem_cst'
        WHEN upper(token) IN ({_UNITS}) THEN 'unidade' WHEN regexp_full_match(token, '[A-Za-z]{{1,4}}[0-9]{{2,8}}') THEN 'codigo' WHEN regexp_full_match(token, '[0-9]{{2,3}}') THEN 'origem_cst' END AS field
        FROM (SELECT p_partkey, unnest({_PARTS}) AS token FROM {_PART_K})""",
    "regex_extract_ids": "SELECT c_custkey, '12' || k || '000199' AS ids, '05/03/2024' AS date, '1.' || substr(k, 4, 3) || ',50' AS value, CAST(NULL AS VARCHAR) AS cpf FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer)",
    "place_cells": "SELECT n_nationkey, 'SP' AS uf, CASE WHEN regexp_matches(n_name, '^[A-Z]') THEN n_name ELSE 'SP' || n_name END AS pais, CASE WHEN n_nationkey % 2 = 0 OR lower(n_name) = 'x' THEN NULL ELSE n_name END AS address, 'Venda de graos' AS nature, CAST(n_nationkey AS VARCHAR) AS serie FROM nation",
    "file_size": "SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN format('{:,.1f} kB', b / 1024) ELSE format('{:,.1f} MB', b / 1048576) END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)",
}
QUERIES = {f.__name__: f for f in (strip_accents, compact_text, clean_description, fix_code, split_glued, classify_token, regex_extract_ids, place_cells, file_size, fuzzy_label)}

"""Queries that rebuild product rows and record fields from tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.operators import layout, normalise, products, records
from docspark.plans import tables

CODE = r"AB-?\d+"  # the codes of ``_table``: any part key
FIELDS = (records.Field("first", ("click",), r"\d+,\d{2}"), records.Field("second", ("purchase",), r"\d+,\d{2}", 60.0, y_max=2000.0))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order and line number, dealt by order."""
    li = tables.dealt(tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"), F.min("l_quantity").alias("q"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items printed as rows of cells, each with a line of words below."""
    li = _items(spark, sf_dir)
    price = (F.col("k") % 90 + 10) * 1.25
    cells = [(10, F.concat(F.lit("AB"), (F.col("k") % 900 + 100).cast("string"))), (100, F.lit("31042090|5102TN")), (400, F.concat(F.col("q").cast("bigint").cast("string"), F.lit(",0000"))), (500, tables.brazilian(price)), (600, tables.brazilian(F.col("q") * price))]
    row = [F.struct(F.lit(float(x)).alias("x"), (F.col("l_linenumber") * 100.0).alias("y"), F.lit(i).alias("i"), c.alias("text")) for i, (x, c) in enumerate(cells)]
    words = [F.struct(F.lit(float(x)).alias("x"), (F.col("l_linenumber") * 100.0 + 40).alias("y"), F.lit(5 + i).alias("i"), F.lit(t).alias("text")) for i, (x, t) in enumerate([(20, "adubo"), (90, "fino"), (150, "Lote 3")])]
    each = li.select("l_orderkey", "l_linenumber", F.explode(F.array(*row, *words)).alias("t"))
    return each.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10 + F.col("t.i")).alias("seq"), F.lit(1).alias("page"), "t.x", "t.y", "t.text")


def content_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products.content_products(_tokens(spark, sf_dir))
    return p.select("doc_id", F.col("product").cast("int").alias("product"), "item.codigo", "item.ncm", "item.cfop", "item.unidade", "item.descricao", F.round("item.quantidade", 3).alias("quantidade"), F.round("item.valor_unitario", 3).alias("valor_unitario"), F.round("item.valor_total", 2).alias("valor_total"))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``_tokens`` with single-cell columns, a header above and no line of words that opens a product."""
    li = _items(spark, sf_dir)
    heads = [("COD. PRODUTO", 100.0), ("DESCRICAO DO PRODUTO", 500.0), ("NCM/SH", 900.0), ("QTDE", 1300.0)]
    n = F.col("l_linenumber")
    cells = [(110.0, F.concat(F.lit("AB"), F.col("k").cast("string"))), (480.0, F.concat(F.lit("adubo "), n.cast("string"))), (905.0, F.lit("31042090")), (1290.0, F.concat(F.col("q").cast("bigint").cast("string"), F.lit(",0000")))]
    row = [F.struct(F.lit(x).alias("x"), (n * 100.0).alias("y"), (n * 10 + i).alias("seq"), c.alias("text")) for i, (x, c) in enumerate(cells)]
    more = F.struct(F.lit(490.0).alias("x"), (n * 100.0 + 50).alias("y"), (n * 10 + 5).alias("seq"), F.lit("fino").alias("text"))
    body = li.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(*row, more)).alias("t")).select("doc_id", "t.*")
    top = li.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(10.0).alias("y"), F.lit(i).alias("seq"), F.lit(t).alias("text")) for i, (t, x) in enumerate(heads)])).alias("t")).select("doc_id", "t.*")
    return body.unionByName(top).withColumn("page", F.lit(1))


def header_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products.header_products(_table(spark, sf_dir), code=CODE)
    return p.select("doc_id", F.col("product").cast("int").alias("product"), "codigo", "descricao", "ncm", "quantidade")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product table for each order, its header printed in four ways.

    Words that are no labels stand in the header row, and in three ways a row with a code label stands above. The first product may
    have its code below; every third one has a remark with a second price beside, and a line after it that belongs to nothing.
    """
    li = _items(spark, sf_dir)
    li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    n, kind, late, third = F.col("n"), F.col("l_orderkey") % 4, (F.col("n") == 1) & (F.col("k") % 2 == 1), F.col("n") % 3 == 0
    code = F.concat(F.lit("AB"), (F.col("k") % 900 + 100).cast("string"))
    body = [
        (0, 110, F.when(~late, code)), (0, 480, F.concat(F.lit("adubo "), n.cast("string"))), (0, 905, F.lit("5102")), (0, 1290, F.concat(F.col("q").cast("bigint").cast("string"), F.lit(",0000"))), (0, 1690, F.lit("10,00")),
        (40, 490, F.lit("fino")), (80, 110, F.when(late, code)), (80, 480, F.when(third, "Obs: safra")), (80, 1690, F.when(third, "20,00")), (120, 490, F.when(third, "perdido")),
    ]
    pick = lambda *texts: F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).when(kind == 2, texts[2]).otherwise(texts[3])
    low = F.when(kind == 3, 60)
    head = [
        (-60, 100, pick("CODIGO", "CODIGO", "CODIGO", None)), (10, 100, pick("COD PRODUTO", "CÓDIGO DO PRODUTO", "CODPROD", "CODIGO")), (10, 520, F.lit("ITEM")), (10, 1310, F.lit("PECAS")), (10, 900, pick("CFOP", "CFOP", None, None)),
        (F.coalesce(low, F.lit(10)), 500, F.lit("DESCRIÇÃO")), (F.coalesce(low, F.lit(10)), 1300, F.lit("QTDE")), (F.coalesce(low, F.lit(10)), 1700, pick("VLR UNIT", "VALOR UNITARIO", "UNIT", "VR")),
    ]

    def laid(rows: DataFrame, cells: list, top: Column, seq: Column) -> DataFrame:
        each = F.array(*[F.struct((top + y).cast("double").alias("y"), F.lit(float(x)).alias("x"), (seq + i).alias("seq"), t.alias("text")) for i, (y, x, t) in enumerate(cells)])
        return rows.select(F.col("l_orderkey").alias("doc_id"), F.inline(each)).where("text IS NOT NULL")

    both = laid(li, body, n * 300, n * 20).unionByName(laid(li.where("n = 1"), head, F.lit(0), F.lit(0)))
    return both.withColumn("page", F.lit(1))


def header_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products.header_products(_tables(spark, sf_dir))
    return p.select("doc_id", F.col("product").cast("int").alias("product"), "codigo", "descricao", "cfop", "quantidade", "valor_unitario")


def product_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir)
    return products.choose(products.header_products(t), products.content_products(t))


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.field_values(tables.event_tokens(spark, sf_dir), FIELDS)


def litres_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    unit = F.struct(F.lit(10.0).alias("x"), F.lit(0).alias("i"), F.when(F.col("l_linenumber") % 2 == 0, "LT").otherwise("KG").alias("text"))
    number = F.struct(F.lit(90.0).alias("x"), F.lit(1).alias("i"), F.concat(F.col("q").cast("bigint").cast("string"), F.lit(",50")).alias("text"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 40.0).alias("y"), "l_linenumber", F.explode(F.array(unit, number)).alias("t"))
    return layout.litres_of_tokens(t.select("doc_id", (F.col("l_linenumber") * 2 + F.col("t.i")).alias("seq"), F.lit(1).alias("page"), "t.x", "y", "t.text"))


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as raw text cells; some quantities and prices are misplaced."""
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("p"))
    n, q = F.col("l_linenumber"), F.concat(F.col("q").cast("bigint").cast("string"), F.lit(",0000"))
    cells = {
        "codigo": F.when(n == 5, "P15 DADOS").otherwise("P15"), "descricao": F.lit("adubo"), "ncm": F.lit("31042090"), "origem_cst": F.lit("0/20"), "cfop": F.when(n == 6, "5102 x").otherwise("5102"),
        "unidade": F.when(n == 1, F.concat(F.lit("TON "), q)).otherwise("TON"), "quantidade": F.when(n != 1, q), "valor_unitario": F.when(n != 2, "10,00"), "desconto": F.when(n == 2, "150,00"),
        "valor_total": F.when(n == 3, "abc").when(n == 4, F.concat(F.lit("1 "), tables.brazilian(F.col("p")))).otherwise(tables.brazilian(F.col("p"))), "bc_icms": F.lit(None), "valor_icms": F.lit(""), "valor_ipi": F.lit("0,00"), "aliquota": F.when(n == 7, "150,00").otherwise("12,00"),
    }
    item = F.struct(*[cells[f].cast("string").alias(f) for f in (*normalise.TEXT_FIELDS, *normalise.ITEM_FIELDS)])
    notes = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("i")))).alias("x"))
    return notes.select(F.col("l_orderkey").cast("string").alias("chave_de_acesso"), F.lit("f").alias("arquivo"), F.lit("1.000,00").alias("valor_da_nota"), F.lit("").alias("peso_bruto"), F.lit("x").alias("peso_liquido"), F.transform("x", lambda v: v["i"]).alias("produtos"))


def normalise_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.normalise(_raw_records(spark, sf_dir))[1].groupBy("campo", "estado").agg(F.count("*").alias("n"))


def normalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = normalise.normalise(_raw_records(spark, sf_dir))[0].select("chave_de_acesso", F.posexplode("produtos").alias("pos", "p"))
    return typed.select("chave_de_acesso", "pos", "p.codigo", "p.cfop", "p.unidade", "p.quantidade", "p.valor_unitario", "p.desconto", F.round("p.valor_total", 2).alias("valor_total"), "p.aliquota")


_FIELD = """SELECT l.doc_id, '{n}' AS field, regexp_extract(t.text, '[0-9]+,[0-9]{{{{2}}}}') AS value FROM
    (SELECT doc_id, seq, x, y FROM tokens WHERE contains(lower(text), '{label}') AND y <= {top} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1) l
    JOIN tokens t ON t.doc_id = l.doc_id WHERE t.seq <> l.seq AND t.y <= {top} AND regexp_matches(t.text, '[0-9]+,[0-9]{{{{2}}}}') AND (abs(t.x - l.x) <= 60 AND abs(t.y - l.y) <= {m} + 25 OR abs(t.y - l.y) <= {m} AND t.x - l.x BETWEEN 10 AND 900)
    QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY abs(t.x - l.x) + 20 * abs(t.y - l.y), abs(t.x - l.x), t.seq) = 1""".replace("{{{{", "{{").replace("}}}}", "}}")
ORACLE_SQL = {
    "content_products": """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS product, 'AB' || CAST(k % 900 + 100 AS VARCHAR) AS codigo, '31042090' AS ncm, '5102' AS cfop, 'TN' AS unidade,
        'adubo fino' AS descricao, q AS quantidade, (k % 90 + 10) * 1.25::DOUBLE AS valor_unitario, round(q * (k % 90 + 10) * 1.25::DOUBLE, 2) AS valor_total FROM li""",
    "header_products": """WITH li AS (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS k, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS INT) AS product, 'AB' || CAST(k AS VARCHAR) AS codigo, 'adubo ' || CAST(n AS VARCHAR) || ' fino' AS descricao, '31042090' AS ncm, CAST(CAST(q AS BIGINT) AS VARCHAR) || ',0000' AS quantidade FROM li""",
    "header_tables": """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM li)
        SELECT l_orderkey AS doc_id, CAST(n AS INT) AS product, 'AB' || CAST(k % 900 + 100 AS VARCHAR) AS codigo, 'adubo ' || CAST(n AS VARCHAR) || ' fino' AS descricao, CASE WHEN l_orderkey % 4 < 2 THEN '5102' END AS cfop,
        CASE WHEN n % 3 = 0 THEN '10,00' ELSE CAST(CAST(q AS BIGINT) AS VARCHAR) || ',0000' END AS quantidade, CASE WHEN n % 3 = 0 THEN '20,00' ELSE '10,00' END AS valor_unitario FROM r""",
    "product_source": "SELECT DISTINCT l_orderkey AS doc_id, true AS by_content FROM lineitem",
    "record_fields": f"WITH {tables.TOKENS_SQL}, a AS ({_FIELD.format(n='first', label='click', top=99999, m=45)}), b AS ({_FIELD.format(n='second', label='purchase', top=2000, m=60)}) FROM a UNION ALL FROM b",
    "normalise_records": """WITH li AS (SELECT l_orderkey, l_linenumber AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey FROM lineitem), a AS (
        SELECT unnest(['valor_da_nota', 'peso_bruto', 'peso_liquido']) AS campo, unnest(['ok', 'vacio', 'no_parseable']) AS estado FROM o UNION ALL
        SELECT unnest(['quantidade', 'valor_unitario', 'desconto', 'valor_total', 'bc_icms', 'valor_icms', 'valor_ipi', 'aliquota']),
            unnest([CASE WHEN n = 1 THEN 'vacio' ELSE 'ok' END, CASE WHEN n = 2 THEN 'vacio' ELSE 'ok' END, CASE WHEN n = 2 THEN 'ok' ELSE 'vacio' END, CASE n WHEN 3 THEN 'no_parseable' WHEN 4 THEN 'limpio' ELSE 'ok' END, 'vacio', 'vacio', 'ok', CASE WHEN n = 7 THEN 'fuera_rango' ELSE 'ok' END]) FROM li UNION ALL
        SELECT unnest(['quantidade', 'unidade']), unnest(['recuperado', 'limpio']) FROM li WHERE n = 1 UNION ALL SELECT 'valor_unitario', 'reubicado' FROM li WHERE n = 2 UNION ALL
        SELECT CASE n WHEN 5 THEN 'codigo' ELSE 'cfop' END, 'limpio' FROM li WHERE n IN (5, 6)) SELECT campo, estado, count(*) AS n FROM a GROUP BY 1, 2""",
    "normalised_items": """WITH li AS (SELECT l_orderkey, l_linenumber AS n, min(l_quantity) AS q, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
        SELECT CAST(l_orderkey AS VARCHAR) AS chave_de_acesso, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n) - 1 AS INT) AS pos, 'P15' AS codigo, '5102' AS cfop, 'TON' AS unidade, q AS quantidade, CASE WHEN n = 2 THEN 150.0::DOUBLE ELSE 10.0::DOUBLE END AS valor_unitario, CAST(NULL AS DOUBLE) AS desconto,
        CASE WHEN n = 3 THEN NULL ELSE round(p, 2) END AS valor_total, CASE WHEN n = 7 THEN NULL ELSE 12.0::DOUBLE END AS aliquota FROM li""",
    "litres_of_tokens": "SELECT l_orderkey AS doc_id, sum(q + 0.5) AS volume_litros FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WHERE l_linenumber % 2 = 0 GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (content_products, header_products, header_tables, product_source, record_fields, normalise_records, normalised_items, litres_of_tokens)}

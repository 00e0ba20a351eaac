"""Queries over positioned tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import layout, tables as rebuilt
from docspark.plans import tables


def label_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.label_first_match(tables.event_tokens(spark, sf_dir), ["purchase", "click"]).select("doc_id", "seq", "page", "x", "y")


def _labels(t: DataFrame) -> DataFrame:
    return t.where(F.col("seq") % 5 == 0)


def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.event_tokens(spark, sf_dir)
    return layout.nearest_value(t, _labels(t), r"\d+,\d{2}").select("doc_id", "l_seq", "seq", "text")


def value_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.event_tokens(spark, sf_dir)
    return layout.value_below(t, _labels(t)).select("doc_id", "l_seq", "seq", "text", "how")


def window_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.window_cascade(tables.event_tokens(spark, sf_dir), r"\d+,\d{2}").select("doc_id", "window", "seq", "text")


def chain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.chain_lines(tables.event_tokens(spark, sf_dir)).select("doc_id", "page", "seq", "line")


def segment_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.event_tokens(spark, sf_dir)
    return layout.segments(t, _labels(t), dy=40.0)


def anchor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.anchor_bands(tables.event_tokens(spark, sf_dir)).select("doc_id", "seq", "band")


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, model and first address of a document; some tokens name a model or an address."""
    named = F.when(F.col("seq") % 97 == 0, F.lit("DANFE simplificado")).when(F.col("seq") % 41 == 0, F.lit("NF-e no 1")).when(F.col("seq") % 29 == 0, F.concat(F.lit("http://x/"), F.col("seq").cast("string")))
    return layout.document_model(tables.event_tokens(spark, sf_dir).withColumn("text", F.coalesce(named, "text"))).select("doc_id", "pages", "modelo", "qr")


def text_recompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.text_recompose(tables.event_tokens(spark, sf_dir))


def sorted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sorted_join(tables.event_tokens(spark, sf_dir), F.col("seq") % 5 == 0)


def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.event_tokens(spark, sf_dir)
    heads = t.where(F.col("seq") % 7 == 0).groupBy("doc_id", F.concat(F.lit("c"), (F.col("seq") % 4).cast("string")).alias("name")).agg(F.min("x").alias("cx"))
    return rebuilt.nearest_column(t.select("doc_id", "seq", "x"), heads).select("doc_id", "seq", "column")


def product_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("band")).agg(F.min("l_partkey").alias("k"))
    rows = li.select("doc_id", "band", F.when(F.col("k") % 2 == 0, F.lit("AB12")).alias("codigo"), F.when(F.col("k") % 3 != 0, F.lit("d")).alias("descricao"), F.when(F.col("k") % 5 != 0, F.lit("1")).alias("quantidade"))
    return rebuilt.open_products(rows).select("doc_id", "band", F.col("product").cast("bigint").alias("product"))


_T = f"WITH RECURSIVE {tables.TOKENS_SQL}"
_NEAR = "SELECT l.doc_id, l.seq AS l_seq, t.seq, t.text, t.x - l.x AS dx, t.y - l.y AS dy, t.x, t.y, t.page, l.page AS l_page FROM tokens l JOIN tokens t ON l.doc_id = t.doc_id WHERE l.seq % 5 = 0"
_BESIDE = "abs(dx) <= 60 AND abs(dy) <= 70 OR abs(dy) <= 45 AND dx BETWEEN {} AND 900"
ORACLE_SQL = {
    "label_first_match": f"{_T} SELECT doc_id, seq, page, x, y FROM tokens WHERE contains(lower(text), 'purchase') OR contains(lower(text), 'click') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1",
    "nearest_value": f"""{_T}, p AS ({_NEAR}) SELECT doc_id, l_seq, seq, text FROM p WHERE seq <> l_seq AND ({_BESIDE.format(10)}) AND regexp_matches(text, '[0-9]+,[0-9]{{2}}')
        QUALIFY row_number() OVER (PARTITION BY doc_id, l_seq ORDER BY abs(dx) + 20 * abs(dy), abs(dx), seq) = 1""",
    "value_below": f"""{_T}, p AS ({_NEAR} AND regexp_full_match(t.text, '[0-9][0-9.,]{{0,14}}')),
        u AS (SELECT doc_id, l_seq, seq, text, 'below' AS how FROM p WHERE dy > 2 AND dy <= 140 AND abs(dx) <= 220 QUALIFY row_number() OVER (PARTITION BY doc_id, l_seq ORDER BY abs(dx), dy, seq) = 1),
        s AS (SELECT doc_id, l_seq, seq, text, 'beside' AS how FROM p WHERE seq <> l_seq AND ({_BESIDE.format(-300)}) AND (doc_id, l_seq) NOT IN (SELECT (doc_id, l_seq) FROM u) QUALIFY row_number() OVER (PARTITION BY doc_id, l_seq ORDER BY abs(dx) + 20 * abs(dy), abs(dx), seq) = 1)
        FROM u UNION ALL FROM s""",
    "window_cascade": f"""{_T}, r AS (SELECT *, CAST(CASE WHEN y BETWEEN 1640 AND 1900 THEN 1 WHEN y BETWEEN 1200 AND 1640 THEN 2 ELSE 3 END AS INT) AS win FROM tokens WHERE regexp_matches(text, '[0-9]+,[0-9]{{2}}'))
        SELECT doc_id, win AS "window", seq, text FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY win, seq) = 1""",
    "chain_lines": f"""{_T}, s AS (SELECT *, CASE WHEN y - lag(y) OVER w <= 16 AND x - lag(x) OVER w <= 180 THEN 0 ELSE 1 END AS step FROM tokens WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, seq))
        SELECT doc_id, page, seq, CAST(sum(step) OVER (PARTITION BY doc_id, page ORDER BY y, x, seq) AS BIGINT) AS line FROM s""",
    "segment_gap": f"""{_T}, p AS ({_NEAR} AND l.page = t.page AND abs(t.y - l.y) <= 40), c AS (SELECT *, CASE WHEN x - lag(x) OVER w > 220 THEN 1 ELSE 0 END AS step FROM p WINDOW w AS (PARTITION BY doc_id, l_seq ORDER BY x, seq)),
        g AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, l_seq ORDER BY x, seq) AS part FROM c), o AS (SELECT doc_id, l_seq, part FROM g WHERE seq = l_seq)
        SELECT g.doc_id, g.l_seq, string_agg(text, ' ' ORDER BY x, seq) AS segment FROM g JOIN o ON g.doc_id = o.doc_id AND g.l_seq = o.l_seq AND g.part = o.part GROUP BY 1, 2""",
    "anchor_bands": f"""{_T}, n AS (SELECT doc_id, seq, y, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, seq) AS k FROM tokens),
        b AS (SELECT doc_id, seq, k, y AS anchor, 1 AS band FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.seq, n.k, CASE WHEN n.y - b.anchor > 28 THEN n.y ELSE b.anchor END, CASE WHEN n.y - b.anchor > 28 THEN b.band + 1 ELSE b.band END FROM b JOIN n ON n.doc_id = b.doc_id AND n.k = b.k + 1)
        SELECT doc_id, seq, band FROM b""",
    "page_count": f"""{_T}, n AS (SELECT doc_id, seq, page, CASE WHEN seq % 97 = 0 THEN 'DANFE simplificado' WHEN seq % 41 = 0 THEN 'NF-e no 1' WHEN seq % 29 = 0 THEN 'http://x/' || CAST(seq AS VARCHAR) ELSE text END AS t FROM tokens),
        k AS (SELECT *, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS c FROM n)
        SELECT doc_id, count(DISTINCT page) AS pages, CASE WHEN bool_or(contains(c, 'danfe')) THEN 'NF-e (DANFE)' WHEN bool_or(contains(c, 'nfe')) THEN 'NF-e' ELSE 'desconhecido' END AS modelo, arg_min(t, seq) FILTER (contains(t, 'http')) AS qr FROM k GROUP BY 1""",
    "text_recompose": f"{_T} SELECT doc_id, string_agg('[p' || CAST(page AS VARCHAR) || ' y=' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ' x=' || CAST(CAST(x AS BIGINT) AS VARCHAR) || '] ' || text, chr(10) ORDER BY y, x, seq) AS full_text FROM tokens GROUP BY 1",
    "sorted_join": f"{_T}, f AS (SELECT doc_id, x AS lx, y AS ly FROM tokens WHERE seq % 5 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1) SELECT t.doc_id, string_agg(text, ' | ' ORDER BY text) AS extra FROM tokens t JOIN f ON f.doc_id = t.doc_id WHERE y > ly AND x < lx + 1400 GROUP BY 1",
    "nearest_column": f"""{_T}, h AS (SELECT doc_id, 'c' || CAST(seq % 4 AS VARCHAR) AS name, min(x) AS cx FROM tokens WHERE seq % 7 = 0 GROUP BY 1, 2)
        SELECT t.doc_id, t.seq, h.name AS "column" FROM tokens t JOIN h ON h.doc_id = t.doc_id WHERE abs(x - cx) <= 320 QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.seq ORDER BY abs(x - cx), name) = 1""",
    "product_open_close": """WITH li AS (SELECT l_orderkey AS doc_id, l_linenumber AS band, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
        f AS (SELECT *, k % 2 = 0 AND k % 3 <> 0 AS strong, k % 3 <> 0 AND k % 5 <> 0 AS weak FROM li),
        s AS (SELECT *, coalesce(max(CASE WHEN strong OR weak THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM f)
        SELECT doc_id, band, nullif(CAST(sum(CASE WHEN strong OR weak AND seen = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY band) AS BIGINT), 0) AS product FROM s""",
}
QUERIES = {f.__name__: f for f in (label_first_match, nearest_value, value_below, window_cascade, chain_lines, segment_gap, anchor_bands, page_count, text_recompose, sorted_join, nearest_column, product_open_close)}

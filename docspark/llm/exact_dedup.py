"""Exact deduplication over an extendible-hash index kept on shared files.

Keys are 64-bit hashes of normalised texts. The directory starts with one bucket; while a bucket holds more keys than a page
takes, the directory doubles and the bucket's range of leading bits is halved. The directory says which bucket owns a
key: an owner task holds whole ranges of keys, chains texts that share one, told apart by their bytes, and
answers for all documents of its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm import common

LEAST_PAGE, MOST_PAGE, PAGES = 1024, 1 << 18, 4096
SEND_BITS, MOST_BITS = 20, 26  # a directory is sent to all tasks up to a million cells, beyond it is joined
SHARE_ROWS = 8192  # documents with one key that one task answers


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def page_of(keys: int) -> int:
    """Keys of a page: some thousand pages for small corpora, pages of a quarter million keys for large ones."""
    return min(MOST_PAGE, max(LEAST_PAGE, keys // PAGES))


def bits_of(keys: int, page_keys: int) -> int:
    """Depth of the directory: two bits more than pages filled evenly would need, so it follows the number of keys."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(max(1, keys / page_keys)))) + 2)


def cell(key: str, bits: int) -> Column:
    """A key's cell of the directory: its leading bits."""
    return F.shiftrightunsigned(F.col(key), 64 - bits).cast("int")


def directory(keys: DataFrame, page_keys: int, bits: int) -> DataFrame:
    """Directory over distinct ``key`` with the number of their ``rows``: ``cell, depth, start, shares``.

    A cell's bucket has the least depth at which it fits a page; ``start`` is the first cell of that bucket and names it.
    ``shares`` says among how many tasks a bucket's owner spreads the documents of the cell, so that copies of one text don't meet in one.
    """
    cells = keys.groupBy(cell("key", bits).alias("cell")).agg(F.count("*").alias("n"), F.max("rows").alias("most"))
    halves = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    filled = halves.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= page_keys) | (F.col("depth") == bits))
    fits = halves.join(filled, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    start = F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)")
    return fits.join(cells, "cell").select("cell", "depth", start.alias("start"), F.ceil(F.col("most") / SHARE_ROWS).cast("int").alias("shares"))


def exact_dedup(docs: DataFrame, page_keys: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which documents are copies: ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each.

    Texts are equal when their normalised bytes are. The smallest id of a group stays. Null counts as
    empty, so null and empty texts are one group; rows that repeat an id count each, and all that carry the
    smallest id are kept; where no row of a group has an id, ``keep_id`` is null and all are kept; an empty table gives an empty
    table; other columns are not read.
    """
    rows = common.texts(docs, id_col, text_col).withColumn("norm", normalised(F.col("text"))).select("doc_id", "norm", F.xxhash64("norm").alias("key"))
    entries = common.stored(rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("place")), "entries")
    keys = common.stored(entries.groupBy("key").agg(F.count("*").alias("rows")), "keys")
    n = keys.count()
    page = page_keys or page_of(n)
    bits = bits_of(n, page)
    cells = common.stored(directory(keys, page, bits), "directory")
    where = F.broadcast(cells) if bits <= SEND_BITS else cells

    # Copies fold before the shuffle, their bytes decide; then each bucket goes to the owner of its range of keys, which chains equal keys.
    placed = rows.withColumn("cell", cell("key", bits)).join(where, "cell")
    owned = placed.groupBy("start", "key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("shares").alias("shares"))
    sent = owned.select("start", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", "shares").repartitionByRange("start")
    chain = F.row_number().over(Window.partitionBy("start", "key").orderBy("keep_id", "text_sha256"))
    index = common.stored(sent.withColumn("chain", chain).sortWithinPartitions("start", "key", "chain"), "index")

    # A document asks the owner of its bucket: both are dealt by bucket and share, nothing else.
    answers = index.select("start", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "key", "text_sha256", "keep_id", "group_size", F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("asks"))
    asking = entries.withColumn("cell", cell("key", bits)).join(where, "cell").select("start", F.pmod("place", "shares").cast("int").alias("share"), "key", "text_sha256", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), "doc_id", F.lit(True).alias("asks"))
    met = answers.unionByName(asking).repartition("start", "share")
    group = Window.partitionBy("start", "share", "key", "text_sha256")
    found = met.withColumns({"keep_id": F.max("keep_id").over(group), "group_size": F.max("group_size").over(group)}).where("asks")
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

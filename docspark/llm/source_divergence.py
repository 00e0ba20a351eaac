"""How the sources of a language differ in their words: divergences over a three-dimensional cube.

The axes are groups, groups and terms, each cut into blocks. A cell belongs to one task, which gets the slices of its two group
blocks in its term block, lays them out as a small matrix and adds up the divergence of each pair over the terms it
sees; an aggregate along the term axis joins the cells.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm import common
from docspark.packaging import ship

SCALE_STEPS, STEP = 3, 1000  # shares are parts of STEP ** SCALE_STEPS
GROUP_BLOCK, TERM_BLOCK = 16, 1024
HELD_TERMS = 1 << 18  # terms that a worker counts before it hands them on
PART_BYTES = 1 << 20
COUNTED = ["lang", "source", "term", "n", "docs"]
_LETTERS = string.ascii_letters.encode()
_SPACED = bytes((c | 32 if c in _LETTERS else c if c > 127 else 32) for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a megabyte at a time: runs of ASCII letters (in lower case) and of characters beyond ASCII."""
    text = text.translate(_SPACED)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    rows: Counter = Counter()

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=COUNTED)
        held.clear()

    terms = 0
    for batch in batches:
        for part in common.slices(batch, 2):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                rows[lang, source] += 1
                before, distinct = len(n), set()
                for found in words(text):
                    n.update(found)
                    distinct.update(found)
                docs.update(distinct)
                terms += len(n) - before
            if terms > HELD_TERMS:
                yield from handed_on()
                terms = 0
    yield from handed_on()
    groups = [pa.array([key[i] for key in rows], pa.string()) for i in (0, 1)]
    yield pa.record_batch([*groups, pa.nulls(len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array(list(rows.values()), pa.int64())], names=COUNTED)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term, and a row with a null term for every group that occurs."""
    ship(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counted = docs.select(*named).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10 ** 9 * count / total)`` without leaving 64 bits: long division, three digits a step. No total: 1."""
    total, left, whole = F.nullif(total, F.lit(0)), count, F.lit(0)
    for _ in range(SCALE_STEPS):
        left = left * STEP
        whole, left = whole * STEP + F.call_function("div", left, total), F.pmod(left, total)
    return F.coalesce(whole + 1, F.lit(1)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(table: pa.Table) -> pa.Table:
    """Sums of one cell: for each pair of its groups the divergence over the terms that any group of the cell has, and their number."""
    groups = table.column("source").combine_chunks().dictionary_encode()
    terms = table.column("term").combine_chunks().dictionary_encode()
    of, names = groups.indices.to_numpy(), groups.dictionary.to_pylist()
    share_of, none_of, block = (table.column(c).to_numpy() for c in ("p", "p0", "block"))
    side, blank = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    side[of], blank[of] = block, none_of
    has = terms.indices.is_valid().to_numpy(zero_copy_only=False)
    dense = np.repeat(blank[:, None], len(terms.dictionary), 1)
    dense[of[has], terms.indices.filter(pa.array(has)).to_numpy()] = share_of[has]
    lang, one, two = (table.column(c)[0].as_py() for c in ("lang", "one", "two"))
    left, right = (np.flatnonzero(side == s) for s in (one, two))
    out: list[tuple[str, str, int]] = []
    for x in left:
        others = right[right > x] if one == two else right
        value = ((dense[x] - dense[others]) ** 2 // (dense[x] + dense[others])).sum(1)
        out += [(*sorted((names[x], names[y])), v) for y, v in zip(others, value.tolist(), strict=True)]
    a, b, v = zip(*out, strict=True) if out else ((), (), ())
    n = len(out)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(v, pa.int64()), "seen": pa.array([dense.shape[1]] * n, pa.int64())})


def source_divergence(
    docs: DataFrame, min_docs: int = 10, top: int = 10, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Pairs of sources of a language and the terms that mark a source: ``lang, source, part, item, value, rank``.

    Null texts, languages and sources are ''. A language keeps the terms in at least ``min_docs`` of its rows; each group gives each
    of them a share of 10**9, smoothed by two occurrences. Part ``pair`` has each other source of the language with the divergence
    over all kept terms (0 without any), part ``term`` the ``top`` terms that a group uses more than its language.
    Ties rank by item. Repeated rows count each; an empty table gives an empty table; other columns are not read. All sums are whole numbers of 64 bits,
    exact up to 9 * 10**15 occurrences.
    """
    counts = common.stored(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = common.stored(kept.select("lang", "term", "lang_n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = common.stored(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("lang")) / group_block)).cast("int")
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = groups.withColumns({"blocks": blocks, "all": F.col("total") + 2 * F.col("terms")})
    groups = groups.withColumns({"block": F.pmod(F.xxhash64("source"), "blocks").cast("int"), "term_blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("int"), "p0": share(F.lit(2).cast("long"), F.col("all"))})
    groups = common.stored(groups, "groups")

    rows = common.keyed_join(used, groups, ["lang", "source"]).withColumn("p", share(F.col("n") + 2, F.col("all")))
    sliced = rows.select("lang", "source", "term", "p", "p0", "block", "blocks", F.pmod(F.xxhash64("term"), "term_blocks").cast("int").alias("slice"))
    bare = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), "p0", "p0", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("slice")).toDF(*sliced.columns)
    replicated = sliced.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = replicated.select("lang", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "slice", "block", "source", "term", "p", "p0")
    partial = cells.groupBy("lang", "one", "two", "slice").applyInArrow(_cell, "lang string, a string, b string, value long, seen long")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    both = pairs.select("lang", "value", "seen", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    here = groups.select("lang", "source", "p0", "terms")
    there = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = common.keyed_join(common.keyed_join(both, here, ["lang", "source"]), there, ["lang", "item"])
    whole = F.col("value") + (F.col("terms") - F.col("seen")) * divergence(F.col("p0"), F.col("q0"))  # terms that no group of the cell has
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", whole.alias("value")).withColumn("rank", F.row_number().over(by_value))

    q = share(F.col("lang_n") + 2, F.col("lang_total") + 2 * F.col("terms"))
    marks = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return ranked.unionByName(marks)


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
     w AS (SELECT lang, source, r, unnest(l) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang),
     c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
     s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
     p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                  1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // CAST(s.total + 2 * v.terms AS HUGEINT) AS p,
                  1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // CAST(v.total + 2 * v.terms AS HUGEINT) AS q
           FROM s JOIN k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
     o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
           FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
     n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM n WHERE part = 'pair' OR rank <= 10
"""

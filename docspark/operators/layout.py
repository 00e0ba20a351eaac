"""Spatial operators over tokens ``doc_id, seq, page, x, y, text``.

Order in a document is ``seq``: it breaks every tie. Searches join a document's tokens with its few labels on ``doc_id``
and, where the distance is bounded, on a grid cell, so a long document is not compared with itself token by token.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import numbers, text

# Search windows of the weight fields, tried in this order.
WEIGHT_WINDOWS = ((1, 1640.0, 1900.0), (2, 1200.0, 1640.0), (3, float("-inf"), float("inf")))


def label_first_match(tokens: DataFrame, labels: list[str], y_min: float | None = None, y_max: float | None = None, page: int | None = None) -> DataFrame:
    """Per document the first token in order whose compact text contains a label (L1)."""
    rows = tokens.where(text.compact(F.col("text")).rlike("|".join(map(re.escape, labels))))
    if y_min is not None:
        rows = rows.where(F.col("y") >= y_min)
    if y_max is not None:
        rows = rows.where(F.col("y") <= y_max)
    if page is not None:
        rows = rows.where(F.col("page") == page)
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("seq", "page", "x", "y", "text"), "seq").alias("t"))
    return first.select("doc_id", "t.*")


def _near(tokens: DataFrame, labels: DataFrame, height: float) -> DataFrame:
    """Pairs of a label and the tokens of its document within ``height``: an equi-join on document and row of a grid."""
    cell = lambda y: F.floor(y / height).cast("long")
    marks = labels.select("doc_id", F.col("seq").alias("l_seq"), F.col("page").alias("l_page"), F.col("x").alias("l_x"), F.col("y").alias("l_y"))
    marks = marks.withColumn("row", F.explode(F.array(cell(F.col("l_y")) - 1, cell(F.col("l_y")), cell(F.col("l_y")) + 1)))
    rows = tokens.withColumn("row", cell(F.col("y")))
    return rows.join(marks, ["doc_id", "row"]).where(F.abs(F.col("y") - F.col("l_y")) <= height).withColumns({"dx": F.col("x") - F.col("l_x"), "dy": F.col("y") - F.col("l_y")})


def _best(pairs: DataFrame, *order: Column) -> DataFrame:
    """The first token for each label, by ``order`` and then place."""
    top = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("seq").alias("by_seq"))
    best = pairs.groupBy("doc_id", "l_seq").agg(F.min_by(F.struct("seq", "x", "y", "text"), top).alias("t"))
    return best.select("doc_id", "l_seq", F.col("t.seq").alias("seq"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.text").alias("text"))


def nearest_value(tokens: DataFrame, labels: DataFrame, pattern: str, margin: float = 45.0, side: str = "right", excluded: list[str] | None = None) -> DataFrame:
    """The value token of each label: in its column above or below, or beside it on its line (L4).

    Cost is ``|dx| + 20 |dy|``, then ``|dx|``, then order in the document.
    """
    pairs = _near(tokens, labels, margin + 25)
    beside = {"right": F.col("dx").between(10, 900), "left": F.col("dx").between(-300, -5), "both": F.col("dx").between(-300, 900)}[side]
    pairs = pairs.where((F.col("seq") != F.col("l_seq")) & ((F.abs("dx") <= 60) | ((F.abs("dy") <= margin) & beside)) & F.col("text").rlike(pattern))
    for label in excluded or []:
        pairs = pairs.where(~text.compact(F.col("text")).startswith(label))
    return _best(pairs, F.abs("dx") + 20 * F.abs("dy"), F.abs("dx"))


def value_below(tokens: DataFrame, labels: DataFrame, pattern: str = r"^[0-9][0-9.,]{0,14}$") -> DataFrame:
    """The number under each label, else beside it on either side."""
    under = _near(tokens, labels, 140.0).where((F.col("dy") > 2) & (F.abs("dx") <= 220) & F.col("text").rlike(pattern))
    first = _best(under, F.abs("dx"), F.col("dy"))
    rest = labels.join(first.select("doc_id", F.col("l_seq").alias("seq")), ["doc_id", "seq"], "left_anti")
    return first.withColumn("how", F.lit("below")).unionByName(nearest_value(tokens, rest, pattern, side="both").withColumn("how", F.lit("beside")))


def window_cascade(tokens: DataFrame, pattern: str, windows: tuple = WEIGHT_WINDOWS) -> DataFrame:
    """Per document the first matching token of the first window that has one."""
    rank = F.coalesce(*[F.when(F.col("y").between(low, high), F.lit(k)) for k, low, high in windows])
    hits = tokens.where(F.col("text").rlike(pattern)).withColumn("window", rank).where("window is not null")
    best = hits.groupBy("doc_id").agg(F.min(F.struct("window", "seq", "text")).alias("t"))
    return best.select("doc_id", "t.window", "t.seq", "t.text")


def chain_lines(tokens: DataFrame, dy: float = 16.0, gap: float = 180.0) -> DataFrame:
    """Tokens with ``line``: a chain in (page, y, x) order breaks where y or x step too far from the last token."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "x", "seq")
    step = F.when((F.col("y") - F.lag("y").over(w) <= dy) & (F.col("x") - F.lag("x").over(w) <= gap), 0).otherwise(1)
    return tokens.withColumn("step", step).withColumn("line", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def segments(tokens: DataFrame, anchors: DataFrame, dy: float = 8.0, gap: float = 220.0) -> DataFrame:
    """The part of each anchor's line that holds it, cut at wide gaps, as text."""
    pairs = _near(tokens, anchors, dy).where(F.col("page") == F.col("l_page"))
    w = Window.partitionBy("doc_id", "l_seq").orderBy("x", "seq")
    cut = pairs.withColumn("step", F.when(F.col("x") - F.lag("x").over(w) > gap, 1).otherwise(0)).withColumn("part", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = cut.where("seq = l_seq").select("doc_id", "l_seq", "part")
    return cut.join(own, ["doc_id", "l_seq", "part"]).groupBy("doc_id", "l_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda t: t["text"]), " ").alias("segment"))


def bands(tokens: DataFrame, tolerance: float = 28.0, carried: tuple[str, ...] = ("text",)) -> DataFrame:
    """``doc_id, band, ts``: the tokens of each band, in (y, x, seq) order, with the columns ``carried``.

    In that order a token joins the band whose first token is within the tolerance (L8, L9). The anchor does not move with the chain, so
    bands need a fold; but a gap over the tolerance always starts one, so the fold runs within runs of tokens without such a gap, not
    over whole documents. All steps are dealt by document: tokens are shuffled once.
    """
    w = Window.partitionBy("doc_id").orderBy("y", "x", "seq")
    step = F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1)
    runs = tokens.select("doc_id", "y", "x", "seq", *carried, step.alias("step")).withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = runs.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("y", "x", "seq", *carried))).alias("ts"))
    starts = F.aggregate("ts", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t["y"] - F.try_element_at(a, F.lit(-1)) > tolerance), F.array_append(a, t["y"].cast("double"))).otherwise(a))
    apart = lambda s: F.transform(s, lambda low, i: F.filter("ts", lambda t: (t["y"] >= low) & ((i + 1 == F.size(s)) | (t["y"] < F.get(s, i + 1)))))
    narrow = F.try_element_at("ts", F.lit(-1))["y"] - F.get("ts", F.lit(0))["y"] <= tolerance
    cut = ordered.select("doc_id", "run", F.when((F.size("ts") == 1) | narrow, F.array("ts")).otherwise(numbers.let(starts, apart)).alias("parts")).withColumn("held", F.size("parts"))
    before = F.sum("held").over(Window.partitionBy("doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    return cut.withColumn("before", before).select("doc_id", "before", F.posexplode("parts").alias("at", "ts")).select("doc_id", (F.col("before") + F.col("at") + 1).cast("int").alias("band"), "ts")


def anchor_bands(tokens: DataFrame, tolerance: float = 28.0) -> DataFrame:
    """Tokens with ``band``, as ``bands`` forms them."""
    others = [c for c in tokens.columns if c not in ("doc_id", "seq")]
    banded = bands(tokens, tolerance, tuple(c for c in others if c not in ("x", "y")))
    return banded.select("doc_id", "band", F.inline("ts")).select("doc_id", "seq", *others, "band")


def litres_of_tokens(tokens: DataFrame) -> DataFrame:
    """Per document the litres named by unit tokens: the nearest number with a separator to the right."""
    units = tokens.where(F.upper(text.compact(F.col("text"))).isin(*[u for u in text.VOLUME_UNITS if len(u) > 1]))
    pairs = _near(tokens.withColumn("text", F.trim("text")), units, 14.0).where((F.col("page") == F.col("l_page")) & (F.col("dx") > 0) & (F.col("dx") <= 260) & F.col("text").rlike(r"^\d[\d.,]*$") & F.col("text").rlike("[.,]"))
    chosen = _best(pairs, F.col("dx")).withColumn("litres", F.array_min(F.filter(numbers.readings(F.col("text")), lambda v: v > 0)))
    return chosen.groupBy("doc_id").agg(F.sum("litres").alias("volume_litros"))


def text_recompose(tokens: DataFrame) -> DataFrame:
    """A document's text with places, one line for each token in (y, x) order."""
    line = F.concat(F.lit("[p"), F.col("page").cast("string"), F.lit(" y="), F.bround("y", 0).cast("bigint").cast("string"), F.lit(" x="), F.bround("x", 0).cast("bigint").cast("string"), F.lit("] "), F.col("text"))
    return tokens.withColumn("line", line).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "line"))), lambda t: t["line"]), "\n").alias("full_text"))


def sorted_join(tokens: DataFrame, label: Column, width: float = 1400.0) -> DataFrame:
    """Tokens below a document's first labelled token and left of its reach, sorted as text and joined."""
    return below_joined(tokens, tokens.where(label).groupBy("doc_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("l")).select("doc_id", "l.*"), width)


def below_joined(tokens: DataFrame, label: DataFrame, width: float = 1400.0) -> DataFrame:
    """The same below labels that are known, one for a document."""
    below = tokens.join(label.select("doc_id", F.col("x").alias("l_x"), F.col("y").alias("l_y")), "doc_id").where((F.col("y") > F.col("l_y")) & (F.col("x") < F.col("l_x") + width))
    return below.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " | ").alias("extra"))


def document_model(tokens: DataFrame) -> DataFrame:
    """Per document the model that its tokens name (P15), its pages (A8) and its first address."""
    key = text.compact(F.col("text"))
    found = tokens.groupBy("doc_id").agg(F.max(key.contains("danfe")).alias("danfe"), F.max(key.contains("nfe")).alias("nfe"), F.count_distinct("page").alias("pages"), F.min_by("text", F.when(F.lower("text").contains("http"), F.col("seq"))).alias("qr"))
    return found.select("doc_id", F.when(F.col("danfe"), "NF-e (DANFE)").when(F.col("nfe"), "NF-e").otherwise("desconhecido").alias("modelo"), "pages", "qr")

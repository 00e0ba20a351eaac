"""Label search in three passes, values that are no labels, whole lines, folding of every character."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import labels, notes, records

SCHEMA = "doc_id string, seq int, page int, x double, y double, text string"
NUMBER = r"[0-9][0-9.,]{0,14}"
SPELT = (
    "PESO LIQUIDO", "PESO LÍQUIDO", "PESO LIQUID0", "PES0 LIQUIDO", "PES0 LIQUID0", "PESO LIOUIDO", "PESO LIQUlDO", "PÊSO LÍQUIDO", "PESO LIQ.", "PESO LIQ", "PESO LIQDO", "PESO LIQUD0",
    "PESO L1QUIDO", "PESO L1QUID0", "PESO LIOU1DO", "PESO LIQUIDO KG", "PESO LÍQUIDO (KG)", "PESO LÍQUIDO KGS", "PESO LIQUIDOKG", "PESO LlQUIDO",
)


def test_weights_under_every_spelling(spark):
    rows = [(s, i, 1, x, y, t) for s in SPELT for i, (x, y, t) in enumerate([(2258.0, 1395.0, s), (2321.0, 1360.0, "254783430"), (2314.0, 1436.0, "37.000,000")])]
    rows += [("split", 0, 1, 2250.0, 1395.0, "PESO"), ("split", 1, 1, 2330.0, 1396.0, "LIQUID0"), ("split", 2, 1, 2323.0, 1436.0, "48.000,000")]
    rows += [("gross", 0, 1, 1992.0, 1386.0, "PES0 BRUT0"), ("gross", 1, 1, 1875.0, 1424.0, "0"), ("none", 0, 1, 1875.0, 1424.0, "0"), ("null", 0, 1, 5.0, 5.0, None)]
    rows += [("beside", 0, 1, 1992.0, 1386.0, "PESO LIQUIDO"), ("beside", 1, 1, 2150.0, 1382.0, "37.000,000")]
    got = {(r.doc_id, r.field): r.value for r in records.field_values(spark.createDataFrame(rows, SCHEMA), notes.WEIGHTS).collect()}
    want = {(s, "peso_liquido"): "37.000,000" for s in (*SPELT, "beside")} | {("split", "peso_liquido"): "48.000,000", ("gross", "peso_bruto"): "0"}
    assert got == want


@pytest.mark.parametrize("label", ["pesobruto", "pesoliquido", "datadeemissao", "valortotaldanota", "naturezadaoperacao"])
def test_pieces_propose_all_that_the_ratio_accepts(label):
    """Every single and double edit of a label that is similar enough keeps one of its pieces in reach."""
    letters = "xo"
    once = lambda s: {s[:i] + c + s[j:] for i in range(1, len(s) + 1) for j in (i, i + 1) for c in ("", *letters) if j <= len(s)}
    for part in {p for s in once(label) for p in once(s)}:
        if abs(len(part) - len(label)) <= 1 and SequenceMatcher(None, part, label).ratio() >= labels.RATIO:
            assert any(part[max(0, at - e) : at + e + labels.PIECE].find(gram) >= 0 for gram, at, e in labels.pieces(label)), part


def test_labels_are_no_values_and_lines_are_whole(spark):
    rows = [("a", 0, 1, 100.0, 500.0, "DESTINATARIO/REMETENTE"), ("a", 1, 1, 100.0, 540.0, "NOME/RAZAO SOCIAL"), ("a", 2, 1, 400.0, 540.0, "CNPJ/CPF"), ("a", 3, 1, 100.0, 572.0, "Fazenda"), ("a", 4, 1, 260.0, 572.0, "Boa Vista"), ("a", 5, 1, 900.0, 572.0, "far")]
    t = spark.createDataFrame(rows, SCHEMA)
    found = {r.field: r.value for r in records.field_values(t, (notes.RECIPIENT[0],), t.limit(1).select("doc_id", F.lit(495.0).alias("low"), F.lit(920.0).alias("high"))).collect()}
    assert found == {"d_nome": "Fazenda Boa Vista"}
    assert records.field_values(t.limit(0), notes.WEIGHTS).count() == 0


def test_folding_of_all_characters(spark):
    codes = [c for c in (*range(1, 0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) != "Cn"]
    rows = [(i, "".join("x" + chr(c) for c in codes[i : i + 400])) for i in range(0, len(codes), 400)]
    got = dict(map(tuple, spark.createDataFrame(rows, "i long, t string").select("i", text.strip_accents(F.col("t"))).collect()))
    for i, t in rows:
        assert got[i] == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

"""The extraction log: which lines a record gets, in which order."""

from __future__ import annotations

from docspark.operators import audit

SCHEMA = "arquivo string, chave_valida boolean, status_extracao string, valor_da_nota double, peso_bruto double, peso_liquido double, produtos array<struct<codigo string, descricao string>>"


def test_lines_of_records(spark):
    rows = [
        ("a", True, "completa", 1.0, 2.0, 3.0, [("1", "cal"), ("2", " "), None]),
        ("b", None, None, None, 2.0, None, None),
        (None, True, "parcial", 1.0, 2.0, 3.0, []),
    ]
    failed = spark.createDataFrame([("c", "ValueError: x")], "doc_id string, motivo string")
    got = [tuple(r) for r in audit.extraction_log(spark.createDataFrame(rows, SCHEMA), failed).orderBy("arquivo", "nr").collect()]
    assert got == [
        (None, 0, "INFO", "produtos: 0"), (None, 1, "INFO", "status: parcial"),
        ("a", 0, "INFO", "produtos: 3"), ("a", 1, "INFO", "status: completa"), ("a", 2, "WARNING", "produtos: item 2 sin descripcion"), ("a", 3, "WARNING", "produtos: item 3 sin descripcion"),
        ("b", 0, "INFO", "produtos: 0"), ("b", 1, "INFO", "status: "), ("b", 2, "WARNING", "valor_da_nota: no encontrado"), ("b", 3, "WARNING", "peso_liquido: no encontrado"), ("b", 4, "WARNING", "chave_de_acesso: no valida"),
        ("c", 0, "ERROR", "ValueError: x"),
    ]


def test_empty(spark):
    assert audit.extraction_log(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id string, motivo string")).count() == 0

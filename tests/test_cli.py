"""The command line over a small store."""

from __future__ import annotations

import json

from docspark import __main__ as cli
from docspark.sources import files


def test_actions(spark, tmp_path, capsys):
    store = {
        "k1": {"arquivo": "a.pdf", "chave_de_acesso": "007", "chave_valida": True, "status_extracao": "completa", "peso_liquido": 12.5, "produtos": [{"codigo": "AB12", "quantidade": 2.0}, {"codigo": "CD34"}]},
        "k2": {"arquivo": "b.pdf", "status_extracao": "parcial", "produtos": []},
    }
    (tmp_path / "s.json").write_text(json.dumps(store))
    assert cli.main(["summary", "--json", f"{tmp_path}/s.json"]) == 0
    assert "records: 2, items: 2, invalid_keys: 1, partial: 1" in capsys.readouterr().out
    assert cli.main(["csv", "--json", f"{tmp_path}/s.json", "--out", f"{tmp_path}/csv", "--columns", "peso_liquido,arquivo,produto_item,unknown"]) == 0
    rows = files.csv_rows(spark, f"{tmp_path}/csv")
    assert rows.columns == ["arquivo", "peso_liquido", "produto_item"]
    assert sorted(tuple(r) for r in rows.collect()) == [("a.pdf", "12,5", "1"), ("a.pdf", "12,5", "2"), ("b.pdf", None, "1")]
    assert cli.main(["normalise", "--json", f"{tmp_path}/s.json", "--out", f"{tmp_path}/n"]) == 0
    assert spark.read.json(f"{tmp_path}/n/records").count() == 2 and spark.read.text(f"{tmp_path}/n/report").count() >= 7

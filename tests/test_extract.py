"""A folder of token files to store, spreadsheet and report."""

from __future__ import annotations

import json

from docspark import __main__ as cli
from docspark.extract import merge_into, unread
from docspark.operators import audit
from docspark.operators.flatten import RECORD_SCHEMA
from docspark.sources import files

ID, OTHER = "12.345.678/0001-95", "98.765.432/0001-10"
BASE = "352401" + "12345678000195" + "55" + "007" + "00000123410000001"[:17] + "1"


def digit(base):
    total = sum(int(c) * (2 + i % 8) for i, c in enumerate(reversed(base)))
    return str(0 if 11 - total % 11 >= 10 else 11 - total % 11)


KEY = BASE + digit(BASE)


def note(key=KEY, value="1.250,00"):
    rows = [
        (40, 100, "CALCARIO"), (40, 220, "OURO"), (40, 330, "LTDA"), (60, 100, ID), (150, 900, "DANFE"), (160, 1200, "No"), (160, 1260, "4321"), (260, 900, "CHAVE DE ACESSO"), (290, 900, key[:22]), (290, 1300, key[22:]),
        (400, 100, "NATUREZA DA OPERACAO"), (430, 100, "Venda de mercadoria"), (500, 100, "DESTINATARIO/REMETENTE"), (540, 100, "NOME/RAZAO SOCIAL"), (570, 100, "Fazenda Boa Vista"), (540, 900, "CNPJ/CPF"), (570, 900, OTHER),
        (540, 1300, "DATA DE EMISSAO"), (570, 1300, "05/03/2024"), (640, 100, "MUNICIPIO"), (670, 100, "Sorriso"), (1000, 1300, "VALOR TOTAL DA NOTA"), (1030, 1300, value),
        (1700, 900, "PESO BRUTO"), (1740, 900, "36.000,00"), (1700, 1300, "PESO LIQUIDO"), (1740, 1300, "35.500,00"), (1900, 100, "DADOS DO PRODUTO/SERVICO"),
        (1940, 100, "CODIGO"), (1940, 300, "DESCRICAO"), (1940, 700, "NCM"), (1940, 900, "UNID"), (1940, 1050, "QUANT"), (1940, 1200, "VALOR UNITARIO"), (1940, 1400, "VALOR TOTAL"),
        (1990, 100, "AB12"), (1990, 300, "calcario moido"), (1990, 700, "25210000"), (1990, 900, "TON"), (1990, 1050, "25,0000"), (1990, 1200, "50,0000"), (1990, 1400, "1.250,00"), (2200, 100, "DADOS ADICIONAIS"), (2240, 100, "entregar cedo"),
    ]
    return json.dumps([(1, float(x), float(y), 1.0, t) for y, x, t in rows])


def test_folder_to_store(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_text(note())
    (tmp_path / "in" / "sub" / "b.pdf").write_text(note(key="1" * 43 + "9", value="x").replace(ID, "11.111.111/0001-11"))
    (tmp_path / "in" / "c.pdf").write_text("broken")
    assert cli.main(["extract", "--folder", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--reader", "json:loads"]) == 0
    assert "records: 2, partial: 1, invalid_keys: 1, items: 2, failed: 1, stored: 2" in capsys.readouterr().out
    store = {r.arquivo: r for r in files.json_store(spark, f"{tmp_path}/out/store").collect()}
    a = store["a.pdf"]
    assert (a.key, a.chave_valida, a.serie, a.numero_nota, a.modelo) == (KEY, True, "7", "4321", "NF-e (DANFE)")
    assert (a.emitente.razao_social, a.emitente.cnpj_cpf) == ("CALCARIO OURO LTDA", ID)
    assert (a.destinatario.nome, a.destinatario.cnpj_cpf, a.destinatario.municipio, a.data_emissao) == ("Fazenda Boa Vista", OTHER, "Sorriso", "05/03/2024")
    assert (a.valor_da_nota, a.peso_bruto, a.peso_liquido, a.status_extracao, a.dados_adicionais) == (1250.0, 36000.0, 35500.0, "completa", "entregar cedo")
    (p,) = a.produtos
    assert (p.codigo, p.descricao, p.ncm, p.unidade, p.quantidade, p.valor_unitario, p.valor_total) == ("AB12", "calcario moido", "25210000", "TON", 25.0, 50.0, 1250.0)
    log = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/log").orderBy("arquivo", "nr").collect()]
    assert [x[1:] for x in log if x[0] == "a.pdf"] == [(0, "INFO", "produtos: 1"), (1, "INFO", "status: completa")]
    lines = [x[3] for x in log if x[0] == "sub/b.pdf"]
    assert lines == ["produtos: 1", "status: parcial", *[f"{c}: no encontrado" for c in audit.LOGGED_FIELDS if store["sub/b.pdf"][c] is None], "chave_de_acesso: no valida"]
    assert [x[0] for x in log if x[2] == "ERROR"] == ["c.pdf"] and log[[x[0] for x in log].index("c.pdf")][3].startswith("JSONDecodeError")
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.pdf"))
    assert cli.main(["status", "--folder", f"{tmp_path}/in", "--json", f"{tmp_path}/out/store"]) == 0
    assert f"files: 3, bytes: {size}, keys: 2" in capsys.readouterr().out
    b = store["sub/b.pdf"]
    assert (b.chave_valida, b.status_extracao, b.key) == (False, "parcial", "sub/b.pdf")


def test_modes(spark, tmp_path):
    path = str(tmp_path / "store")

    def run(mode, *rows):
        new = spark.createDataFrame([{"key": k, "arquivo": a, "serie": s} for k, a, s in rows], f"key string, {RECORD_SCHEMA}")
        merged = {r.key: r.state for r in merge_into(new, path, f"{tmp_path}/merged", mode).collect() if r.state != "kept"}
        return merged, {r.key: (r.arquivo, r.serie) for r in files.json_store(spark, path).collect()}

    documents = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "doc_id string")
    assert unread(documents, path).count() == 3
    assert run("fill", ("k", "a.pdf", None), ("m", "c.pdf", "1")) == ({"k": "inserted", "m": "inserted"}, {"k": ("a.pdf", None), "m": ("c.pdf", "1")})
    assert [r.doc_id for r in unread(documents, path).collect()] == ["b.pdf"]
    assert run("only-new", ("k", "b.pdf", "7")) == ({"k": "unchanged"}, {"k": ("a.pdf", None), "m": ("c.pdf", "1")})
    assert run("fill", ("k", "b.pdf", "7")) == ({"k": "updated"}, {"k": ("a.pdf", "7"), "m": ("c.pdf", "1")})
    assert run("fill", ("k", "b.pdf", "8"))[0] == {"k": "unchanged"}
    assert run("replace", ("k", "b.pdf", "8")) == ({"k": "updated"}, {"k": ("b.pdf", "8"), "m": ("c.pdf", "1")})

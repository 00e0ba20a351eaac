"""Stores, merges of nested records, streams of versions, folding, and what the command line says of bad cells."""

from __future__ import annotations

import itertools
import json
import unicodedata

from pyspark.sql import functions as F

from docspark import __main__ as cli
from docspark.functions import text
from docspark.operators import audit, merge
from docspark.sources import files, sinks
from docspark.streaming import upsert


def test_store_is_read_again(spark, tmp_path):
    store = {"k1": {"arquivo": "a.pdf", "peso_liquido": 12.5, "emitente": {"cnpj_cpf": "1"}, "produtos": [{"codigo": "AB12", "quantidade": 2.0}]}, "k2": {"arquivo": "b\nc.pdf", "produtos": []}}
    (tmp_path / "s.json").write_text(json.dumps(store))
    first = files.json_store(spark, f"{tmp_path}/s.json")
    rows = sorted(map(str, first.collect()))
    sinks.write_json(first, f"{tmp_path}/out")
    again = files.json_store(spark, f"{tmp_path}/out")
    assert sorted(map(str, again.collect())) == rows and again.columns == first.columns
    # A store may be written from its own records.
    sinks.write_json(again.where("key = 'k1'"), f"{tmp_path}/out")
    assert [r.key for r in files.json_store(spark, f"{tmp_path}/out").collect()] == ["k1"]


def test_validate(spark, tmp_path, capsys):
    good = {"k": {"arquivo": "a.pdf", "peso_bruto": 1, "produtos": [{"quantidade": 2.5, "valor_total": None}]}}
    bad = {"k": {"arquivo": "a.pdf", "peso_bruto": "1.234,50", "produtos": [{"quantidade": "2,5"}, {"quantidade": ""}]}}
    for name, store in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(store))
    assert cli.main(["validate", "--json", f"{tmp_path}/good.json"]) == 0
    assert "errors: 0" in capsys.readouterr().out
    assert cli.main(["validate", "--json", f"{tmp_path}/bad.json"]) == 1
    said = capsys.readouterr().out
    assert "records: 1, items: 2, errors: 2" in said and "a.pdf nota.peso_bruto = 1.234,50" in said and "a.pdf prod.quantidade = 2,5" in said


NESTED = "key string, version int, note string, emitente struct<nome:string,sub:struct<uf:string>>, produtos array<struct<codigo:string,q:double>>, tags array<string>"
VERSIONS = [
    ("a", 1, " ", (None, (" ",)), [("A", None), (" ", 2.0)], []),
    ("a", 2, "x", ("N", None), [("B", 5.0), ("C", 7.0), ("D", 1.0)], ["t"]),
    ("a", 3, "y", ("M", ("SP",)), None, ["u"]),
    ("b", 1, None, None, None, None),
    ("b", 2, "", (None, None), [], None),
    (None, 4, "n", ("K", None), [("Z", 1.0)], None),
]


def test_nested_fill_only(spark):
    got = {r.key: r for r in merge.fill_only(spark.createDataFrame(VERSIONS, NESTED)).collect()}
    a = got["a"]
    assert (a.note, a.emitente.nome, a.emitente.sub.uf, a.tags) == ("x", "N", "SP", ["t"])
    assert [tuple(p) for p in a.produtos] == [("A", 5.0), ("C", 2.0), ("D", 1.0)]
    assert got["b"].produtos == [] and got["b"].emitente.nome is None and got["b"].emitente.sub is None
    assert got[None].produtos[0].codigo == "Z" and len(got) == 3


def test_stream_doesnt_depend_on_batches(spark, tmp_path):
    rows = [("k", 1, " ", None), ("k", 2, "y", 2.0), ("k", 3, "x", 3.0), ("m", 5, None, None), ("m", 4, "", 1.0)]
    schema = "key string, version int, note string, total double"
    want = None
    for n, order in enumerate(itertools.islice(itertools.permutations(rows), 0, None, 29)):
        path = f"{tmp_path}/r{n}"
        for k, part in enumerate((order[:2], order[2:3], order[3:])):
            spark.createDataFrame(list(part), schema).write.mode("append").json(f"{path}/in/{k}")
        for k in range(3):
            source = spark.readStream.schema(schema).json(f"{path}/in/{{{','.join(str(i) for i in range(k + 1))}}}")
            upsert.merge_stream(source, f"{path}/out", f"{path}/check").awaitTermination()
        got = sorted(map(str, (tuple(r[c] for c in ("key", "version", "note", "total")) for r in upsert.latest(spark, f"{path}/out").collect())))
        want = want or got
        assert got == want
    assert want == ["('k', 1, 'y', 2.0)", "('m', 4, '', 1.0)"]


def test_folding(spark):
    samples = ["Čeština ő Łódź ﬁ ① ªº²", "São João Ñandú", "ﬂuß Ǆ № ™", "e\u0301a\u0308", "plain", "", "Ａｂｃ１２"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").orderBy("i").select(text.strip_accents(F.col("s"))).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)) for s in samples]


def test_detail_by_file(spark):
    cells = spark.createDataFrame([(1, "f1", "1,00", "x"), (2, "f1", "2 x 3,00", ""), (3, "f2", "sem", "5")], "seq long, archivo string, valor_total string, quantidade string")
    judged = audit.audit_cells(cells, ["valor_total", "quantidade"])
    assert sorted(map(tuple, audit.by_file(judged).collect())) == [("f1", 4, 2, "quantidade 1"), ("f2", 2, 1, "valor_total 1")]
    lines = [r.line for r in audit.report(judged.withColumn("nr", F.col("seq"))).orderBy("part", "nr").collect()]
    assert lines[0].startswith("ok") and "quantidade | no_parseable | 1" in lines and "f2 | 2 | 1 | valor_total 1" in lines


def test_anomalies_are_numbered_over_files_without_one_task(spark):
    cells = [(i, f if f != "f3" else None, 0, "peso_bruto", "x", "no_parseable" if i % 3 else "ok") for i, f in enumerate(f"f{k % 23}" for k in range(400))]
    shuffled = spark.createDataFrame(cells, "seq int, archivo string, nr int, campo string, crudo string, estado string").repartition(7)
    numbered = audit.anomalies(shuffled)
    got = [(r.nr, r.archivo, r.seq) for r in numbered.collect()]
    kept = sorted(((c[1] is not None, c[1] or ""), c[0]) for c in cells if c[5] != "ok")
    assert sorted(got) == [(i, f[1] or None, s) for i, (f, s) in enumerate(kept, 1)]
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert audit.anomalies(shuffled.limit(0)).collect() == []

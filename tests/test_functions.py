"""Fixtures of the number parser, keys, labels, cells, merging and sinks."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from docspark.functions import cells, checksum, numbers, text
from docspark.operators import fuzzy, layout, merge, tables
from docspark.sources import files, sinks
from docspark.streaming import upsert

NUMBERS = [
    ("215.380,40", 215380.4), ("12.664.37", 12664.37), ("5.821.0919", 5821.0919), ("37,0000", 37.0), ("1.000", 1000.0), ("20.080.000", 20080000.0),
    ("1,234.56", 1234.56), ("0,00|17.000,0", 0.0), ("48,0000 5.907,0600", 5907.06), ("0,0017,000,00", None), ("", None), (None, None), ("R$ 12,50", 12.5), ("-5,00", 5.0), ("abc", None),
]


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return frame.select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), NUMBERS)
def test_parse_number(spark, raw, want):
    got = one(spark, numbers.parse_number(F.col("t")), t=(raw, "string"))
    assert got is None if want is None else got == pytest.approx(want)


def test_recognition_errors_in_codes(spark):
    codes = {"POIS": "P015", "PO15": "PO15", "SOIS": "SOIS", "AB12": "AB12"}
    for raw, want in codes.items():
        assert one(spark, text.fix_code(F.col("t")), t=(raw, "string")) == want


def test_keys(spark):
    base = "3524010001234567890155001000000000000012345"
    key = base + str(one(spark, checksum.check_digit(F.col("t")), t=(base, "string")))
    assert one(spark, checksum.is_valid(F.col("t")), t=(key, "string"))
    wrong = key[:30] + str((int(key[30]) + 1) % 10) + key[31:]
    assert not one(spark, checksum.is_valid(F.col("t")), t=(wrong, "string"))
    assert one(spark, checksum.valid_window(F.col("t")), t=("77" + key + "1", "string")) == key
    fixed = one(spark, checksum.repair(F.col("t"), F.array(F.lit(key[6:20]))), t=(wrong, "string"))
    tries = [wrong[:j] + d + wrong[j + 1 :] for j in range(44) for d in "0123456789" if d != wrong[j]]
    good = lambda k: (lambda s: str(0 if 11 - s % 11 >= 10 else 11 - s % 11) == k[43])(sum(int(k[42 - i]) * (i % 8 + 2) for i in range(43)))
    assert fixed == next(k for k in tries if good(k) and k[6:20] == key[6:20])
    assert one(spark, checksum.repair(F.col("t"), F.lit(None).cast("array<string>"), "strict"), t=(wrong, "string")) is None
    assert one(spark, checksum.repair(F.col("t"), F.array(F.lit(key[6:20]))), t=("1" + key[:40] + key[41:], "string")) != ""


def test_fuzzy_labels(spark):
    values = spark.createDataFrame([("PESO BRUTO KG",), ("PES0 BRUT0",), ("PESO LIQUIDO",), (None,), ("",)], "text string")
    got = {r.text: r.matches for r in fuzzy.fuzzy_label(values, ["pesobruto"]).collect()}
    assert got == {"PESO BRUTO KG": True, "PES0 BRUT0": False, "PESO LIQUIDO": False, None: False, "": False}
    assert {r.text: r.matches for r in fuzzy.fuzzy_label(values, ["pes0bruto"]).collect()}["PES0 BRUT0"]


def test_label_over_two_tokens(spark):
    t = spark.createDataFrame([("a", 0, 1, 10.0, 10.0, "PESO"), ("a", 1, 1, 60.0, 12.0, "LIQUIDO"), ("a", 2, 1, 10.0, 90.0, "x")], "doc_id string, seq int, page int, x double, y double, text string")
    assert [tuple(r) for r in fuzzy.in_lines(t, ["pesoliquido"]).collect()] == [("a", 1, 0)]


def test_litres(spark):
    t = spark.createDataFrame([("a", 0, 1, 10.0, 10.0, "LT"), ("a", 1, 1, 60.0, 12.0, "48,000"), ("b", 0, 1, 10.0, 10.0, "L"), ("b", 1, 1, 60.0, 12.0, "5,0"), ("c", 0, 1, 10.0, 10.0, "LT"), ("c", 1, 1, 60.0, 12.0, "500")], "doc_id string, seq int, page int, x double, y double, text string")
    assert [tuple(r) for r in layout.litres_of_tokens(t).collect()] == [("a", 48.0)]
    item = "array<struct<unidade:string,quantidade:string,valor_unitario:string,valor_total:string>>"
    sums = {
        2948.7221: [("LT", "1.000,0000", "1,00", "1.000,00"), ("LT", "984,8231", "1,00", "984,82"), ("LT", "963,899", "6,00", "5.783,39")],
        963.899: [("LT", "963,899", None, None)],
        1000.0: [("LT", "1.000,00", None, None), ("TON", "5,00", None, None)],
        None: [("TON", "5,00", None, None)],
    }
    for want, items in sums.items():
        assert one(spark, tables.litres(F.col("p")), p=(items, item)) == want
    assert one(spark, tables.litres(F.col("p")), p=([], item)) is None


def test_cells(spark):
    for value, kind, want in [(215380.4, "double", "215380,4"), (37000.0, "double", "37000"), (None, "double", ""), (True, "boolean", "SI"), (False, "boolean", "NAO"), ("007", "string", '="007"'), ("123456789012", "string", '="123456789012"'), ("7", "string", "7"), (0.1 + 0.2, "double", "0,3")]:
        assert one(spark, cells.cell(F.col("v"), kind), v=(value, kind)) == want


def test_merge_keeps_first_filled(spark):
    v = spark.createDataFrame([("k", 1, " ", False, None), ("k", 2, "b", True, 5), ("k", 3, "c", True, 6)], "key string, version int, s string, ok boolean, n int")
    assert tuple(merge.fill_only(v).first()) == ("k", "b", False, 5)
    both = merge.fill_only(merge.fill_only(v.where("version < 3")).withColumn("version", F.lit(1)).unionByName(v.where("version = 3")))
    assert tuple(both.first()) == ("k", "b", False, 5)


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a;b", 'x"y', ""), ("1", "2", "3")], "p string, q string, r string")
    sinks.write_csv(rows, f"{tmp_path}/csv")
    part = next(p for p in (tmp_path / "csv").glob("part-*"))
    assert part.read_bytes().startswith("﻿".encode()) and b"\r\n" in part.read_bytes()
    back = files.csv_rows(spark, f"{tmp_path}/csv")
    assert back.columns == ["p", "q", "r"] and sorted(r.p for r in back.collect()) == ["1", "a;b"]


def test_json_store(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"k1": {"arquivo": "a", "produtos": [{"codigo": "x", "quantidade": 2.5}]}, "k2": {"emitente": {"cnpj_cpf": "1"}}}')
    got = {r.key: r for r in files.json_store(spark, f"{tmp_path}/s.json").collect()}
    assert got["k1"].produtos[0].quantidade == 2.5 and got["k2"].emitente.cnpj_cpf == "1"


def test_tokens_of_files(spark, tmp_path):
    for name, content in (("a.pdf", b"one two"), ("b.pdf", b" ")):
        (tmp_path / name).write_bytes(content)

    def read(content):
        return [(1, float(i), 0.0, 1.0, w.decode()) for i, w in enumerate(content.split())] or None

    tokens, failed = files.tokens_of(files.document_files(spark, str(tmp_path)), read)
    assert [(r.doc_id, r.seq, r.text) for r in tokens.orderBy("seq").collect()] == [("a.pdf", 0, "one"), ("a.pdf", 1, "two")]
    assert [r.doc_id for r in failed.collect()] == ["b.pdf"]


def test_stream_merge(spark, tmp_path):
    schema = "key string, version int, s string"
    for i, part in enumerate(([("k", 1, ""), ("m", 1, "m")], [("k", 2, "x")], [("k", 3, "y")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upsert.merge_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r.key: r.s for r in upsert.latest(spark, f"{tmp_path}/out").collect()} == {"k": "x", "m": "m"}


def test_number_text_of_tiny_and_huge_numbers(spark):
    values = [0.0, -0.5, 1e-4, 0.00012345678901234, 9.5e-5, 1e-5, -2.5e-9, 3e-300, 123456789012.75, 1234567890123.25, 1e14, 999999999999999.0, 1e15, 1.5e15, -1.23456789012345e20, 1e300, 0.1 + 0.2]
    python = [str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.12g}".replace(".", ",") for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", cells.number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == python


def brute_repair(digits, issuers):
    """The first single substitution, by window, place and digit, that is valid and names an issuer."""
    valid = lambda k: (11 - sum(int(c) * (i % 8 + 2) for i, c in enumerate(reversed(k[:43]))) % 11) % 11 % 10 == int(k[43])
    for at in range(len(digits) - 43):
        w = digits[at : at + 44]
        for j in range(44):
            for d in "0123456789":
                c = w[:j] + d + w[j + 1 :]
                if d != w[j] and valid(c) and (not issuers or c[6:20] in issuers):
                    return c


def test_repair_by_brute_force(spark):
    r = random.Random(7)
    rows = []
    for n in range(600):
        digits = "".join(r.choice("0123456789") for _ in range(44 + n % 4))
        wrong = digits[6:10] + str((int(digits[10]) + 1) % 10) + digits[11:20]
        rows.append((digits, [None, [], [digits[7:21], digits[6:20]], [wrong], ["0" * 14]][n % 5]))
    found = spark.createDataFrame(rows, "d string, i array<string>").select("d", "i", checksum.repair(F.col("d"), F.col("i")).alias("r")).collect()
    assert [r.r for r in found] == [brute_repair(r.d, r.i) for r in found]
    assert len({r.r is None for r in found}) == 2


def test_repair_takes_no_change_at_a_time(spark):
    """30,000 keys in one task; 440 tries for each took longer."""
    keys = spark.range(0, 30_000, 1, 1).select(F.rpad(F.sha2(F.col("id").cast("string"), 256).substr(1, 44), 44, "0").alias("h")).select(F.translate("h", "abcdef", "012345").alias("d"))
    began = time.time()
    keys.select(checksum.repair(F.col("d"), F.array(F.substring("d", 7, 14)), "strict").alias("r")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 10

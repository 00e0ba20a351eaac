"""The document source: batches, tasks by bytes, one engine a worker, failures as rows, streams, status of a folder."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from docspark.sources import documents, files

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in (("b.pdf", "um dois"), ("sub/a.pdf", "tres"), ("c.pdf", "broken"), ("d.pdf", ""), ("e.txt", "no document")):
        (tmp_path / "in" / name).write_text(content)
    for i in range(12):
        (tmp_path / "in" / "sub" / f"s{i:02}.pdf").write_text("scan:")
    return str(tmp_path / "in")


@pytest.fixture
def source(spark):
    documents.register(spark)
    spark.sparkContext.addPyFile(str(Path(__file__).resolve().parent / "decoders.py"))
    return lambda path, **more: spark.read.format(documents.NAME).options(reader="decoders:words", fallback="decoders:recognise", engine="decoders:engine", **more).load(path)


def test_tokens_failures_and_engines(source, folder):
    rows = source(folder, partitionBytes=3 * documents.OPEN_BYTES).collect()
    tokens = sorted((r.doc_id, r.seq, r.page, r.x, r.text) for r in rows if r.motivo is None and r.page == 1)
    assert tokens == [("b.pdf", 0, 1, 0.0, "um"), ("b.pdf", 1, 1, 10.0, "dois"), ("sub/a.pdf", 0, 1, 0.0, "tres")]
    assert {r.doc_id: r.motivo for r in rows if r.motivo} == {"c.pdf": "ValueError: not a document", "d.pdf": "no tokens"}
    made = {r.text for r in rows if r.page == 2}
    assert sum(r.page == 2 for r in rows) == 12 and len(made) == len({m.split("-")[0] for m in made})


def test_options_and_empty_folder(spark, source, tmp_path):
    assert source(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="needs the option reader"):
        spark.read.format(documents.NAME).load(str(tmp_path)).count()


def test_shares_by_bytes():
    files = [("/f/c", "c", 5), ("/f/a", "a", 50), ("/f/b", "b", 4), ("/f/d", "d", 0)]
    assert [[d for _, d, _ in s.files] for s in documents.shares(files, most=11, each=1)] == [["a"], ["b", "c"], ["d"]]
    assert documents.shares([]) == []


def test_stream_and_status(spark, source, folder, tmp_path):
    import decoders

    decoder = documents.Decoder(decoders.words, decoders.recognise, decoders.engine)

    def run():
        found = documents.tokens_of(documents.document_stream(spark, folder, files_at_once=5), decoder)
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.doc_id, r.motivo or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 16 and ("c.pdf", "ValueError: not a document") in first
    (tmp_path / "in" / "sub" / "new.pdf").write_text("quatro")
    assert run() == sorted([*first, ("sub/new.pdf", "")])
    whole = {r.doc_id: (r.length, bytes(r.content)) for r in files.document_files(spark, folder).collect()}
    assert len(whole) == 17 and whole["d.pdf"] == (0, b"") and whole["b.pdf"] == (7, b"um dois")
    size = sum(p.stat().st_size for p in (tmp_path / "in").rglob("*.pdf"))
    records = spark.createDataFrame([("k",), ("k",), ("m",)], "key string")
    assert tuple(documents.folder_status(spark, folder, records).first()) == (17, size, 2)
    assert tuple(documents.folder_status(spark, str(tmp_path / "seen")).first()) == (0, 0, 0)


def test_rows_of_a_decoder():
    rows = lambda read, fallback=None: list(documents.Decoder(read, fallback).rows("d", lambda: b"x"))
    assert rows(lambda c: [(1, 2, 3, None, None)]) == [("d", 0, 1, 2.0, 3.0, None, None, None)]
    assert rows(lambda c: [(1, 2, 3)])[0][7].startswith("ValueError")
    assert rows(lambda c: 1 / 0, lambda c: [(1, 0, 0, 1, "t")]) == [("d", 0, 1, 0.0, 0.0, 1.0, "t", None)]
    assert rows(None) == [("d", None, None, None, None, None, None, "no tokens")]

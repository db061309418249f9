"""Readers, writers and the stream of files."""

import zipfile

from pyspark.sql import functions as F

from docquarry.functions.text import array_of
from docquarry.operators import tables
from docquarry.sinks import writers
from docquarry.sources import readers
from docquarry.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def files(folder):
    (folder / "a_report.txt").write_text("The hospital met.\nAll was well.", encoding="utf-8")
    (folder / "b.txt").write_bytes("Caf\xe9 menu".encode("latin-1"))
    (folder / "c.xyz").write_text("x")
    body = "<w:p><w:r><w:t>First line</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def test_read(spark, tmp_path):
    files(tmp_path)
    rows = {r.filename: r for r in readers.read(spark, str(tmp_path)).collect()}
    assert rows["a_report.txt"].document_type == "healthcare" and rows["a_report.txt"].word_count == 6
    assert rows["b.txt"].text == "Café menu"
    assert rows["d.docx"].text == "First line\nA | B"
    assert rows["c.xyz"].text is None and "unsupported" in rows["c.xyz"].error
    assert readers.read(spark, str(tmp_path), keep_errors=False).count() == 3


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    files(source)
    docs = ingest.incoming(spark, str(source)).filter(F.col("error").isNull())
    ingest.append(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, "short")], "rec_key int, text string")
    writers.csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(r.text for r in back.collect()) == ['a "b"\nc', "short"]
    assert writers.recommendation_rows(df).count() == 0


def test_tables(spark):
    head, row = array_of(["Name", "Owner of it"]), array_of(["Ann", "Bob"])
    (r,) = spark.range(1).select(tables.as_text(F.array(head, row)).alias("t"), tables.as_text(F.array(head)).alias("e")).collect()
    assert (r.t, r.e) == ("Name: Ann | Owner of it: Bob", "")

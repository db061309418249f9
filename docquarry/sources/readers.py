"""Documents from files of text, Word and PDF, one row a file; what cannot be read comes out as a row with its error."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.classify import document_type
from docquarry.functions.text import clean_document, tokens

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LARGEST = 500 * 1024 * 1024  # bytes of a file that is read
SCHEMA = "filename string, text string, word_count int, file_type string, file_size_mb double, document_type string, processed_at timestamp, error string"


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs, then each table row's non-empty cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{W}t"))
    lines = [said(p) for p in body.findall(f"{W}p") if said(p).strip()]
    for table in body.findall(f"{W}tbl"):
        for row in table.iter(f"{W}tr"):
            cells = [" ".join(filter(None, (said(p).strip() for p in cell.iter(f"{W}p")))) for cell in row.findall(f"{W}tc")]
            if any(cells):
                lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


def pdf_text(data: bytes) -> str:
    """The pages' texts joined by blank lines, by a PDF library if one is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as problem:
        raise RuntimeError("no PDF library is installed") from problem
    pages = [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]
    text = re.sub(" {2,}", " ", "\n\n".join(p for p in pages if p.strip()))
    return re.sub(r"(?<!\n)\n(?!\n)", " ", text)


def plain_text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


DECODERS = {"txt": plain_text, "docx": docx_text, "pdf": pdf_text}


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errors = [], []
        for kind, data in zip(pdf["file_type"], pdf["content"], strict=True):
            try:
                if kind not in DECODERS:
                    raise ValueError(f"unsupported file type: {kind}")
                texts.append(DECODERS[kind](data))
                errors.append(None)
            except Exception as problem:
                texts.append(None)
                errors.append(str(problem) or type(problem).__name__)
        yield pd.DataFrame({"filename": pdf["filename"], "file_type": pdf["file_type"], "length": pdf["length"], "raw": texts, "error": errors})


def read(spark: SparkSession, path: str, keep_errors: bool = True) -> DataFrame:
    """Documents under ``path``: decoded by their extension, cleaned and classified; files too large to be read come out with that error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = documents(files.filter(F.col("length") <= LARGEST), keep_errors)
    return rows.unionByName(oversized(files)) if keep_errors else rows


def oversized(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Files that are too large to be read, as documents with that error; their contents are not touched."""
    name = F.element_at(F.split("path", "/"), -1)
    none = lambda kind: F.lit(None).cast(kind)
    return files.filter(F.col("length") > largest).select(
        name.alias("filename"), none("string").alias("text"), none("int").alias("word_count"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("file_type"), F.round(F.col("length") / 1048576, 2).alias("file_size_mb"),
        none("string").alias("document_type"), F.current_timestamp().alias("processed_at"), F.lit(f"larger than {largest} bytes").alias("error"),
    )


def placeholders(files: DataFrame) -> DataFrame:
    """Files as documents without any decoder: plain texts as they are, others as a note of their names."""
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.lower(name).endswith(".txt")
    rows = files.select(name.alias("filename"), F.when(plain, F.decode("content", "UTF-8")).otherwise(F.concat(F.lit("[Content from "), name, F.lit(" - processing not available]"))).alias("text"))
    return rows.select("filename", "text", F.size(tokens(F.col("text"))).alias("word_count"), F.lit("general").alias("document_type"), F.current_timestamp().alias("processed_at"), F.length("text").alias("file_size"))


def documents(files: DataFrame, keep_errors: bool = True) -> DataFrame:
    """A table of binary files, or a stream of them, as documents."""
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("file_type"), "length", "content")
    rows = named.mapInPandas(_decode, "filename string, file_type string, length bigint, raw string, error string").withColumn("text", clean_document(F.col("raw")))
    rows = rows.select(
        "filename", "text", F.when(F.col("text").isNotNull(), F.size(tokens(F.col("text")))).alias("word_count"), "file_type", F.round(F.col("length") / 1048576, 2).alias("file_size_mb"),
        F.when(F.col("error").isNull(), document_type(F.col("text"), F.col("filename"))).alias("document_type"), F.current_timestamp().alias("processed_at"), "error",
    )
    return rows if keep_errors else rows.filter(F.col("error").isNull())

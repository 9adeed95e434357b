"""Document files as cleaned texts."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.text import clean_text

SUFFIXES = ("pdf", "docx", "txt", "md")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then every table row with its cells joined by bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [text(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        lines.append(" | ".join(" ".join(filter(None, map(text, cell.findall(f"{_W}p")))).strip() for cell in row.findall(f"{_W}tc")))
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    from pypdf import PdfReader  # optional: files of this kind fail without it

    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def raw_text(suffix: str, content: bytes) -> str:
    if suffix == "docx":
        return docx_text(content)
    if suffix == "pdf":
        return pdf_text(content)
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported file type .{suffix}. Supported: {', '.join(SUFFIXES)}")
    return content.decode("utf-8", errors="replace")


def extracted(files: DataFrame, min_chars: int = 20, max_bytes: int = 50 * 2**20) -> DataFrame:
    """(hash, name, path, text, error) of binary files (path, length, content); one
    row per distinct content.  Files over ``max_bytes`` are not read and have an error."""

    def run(frames):
        for f in frames:
            out = []
            for path, content in zip(f.path, f.content):
                if content is None:
                    out.append((path, None, f"more than {max_bytes} bytes"))
                    continue
                try:
                    out.append((path, raw_text(path.rsplit(".", 1)[-1].lower(), bytes(content)), None))
                except Exception as e:  # a bad file is a failed document, not a failed job
                    out.append((path, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    hashes = files.select("path", F.sha2("content", 256).alias("hash")).groupBy("hash").agg(F.min("path").alias("path"))
    texts = files.select("path", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content")).mapInPandas(run, "path string, text string, error string")
    out = hashes.join(texts, "path").withColumn("text", clean_text(F.col("text")))
    short = F.col("error").isNull() & (F.length("text") < min_chars)
    return out.select("hash", F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.when(~short, F.col("text")).alias("text"), F.when(short, "No extractable text found").otherwise(F.col("error")).alias("error"))


def read_documents(spark: SparkSession, path: str, **how) -> DataFrame:
    return extracted(spark.read.format("binaryFile").load(path), **how)

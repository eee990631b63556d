"""Document sources: binary files become page rows; failures are rows, too."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File kinds by extension.
KINDS = {"pdf": "pdf", "docx": "word", "doc": "word", "pptx": "ppt", "ppt": "ppt", "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "txt": "text", "md": "text", "markdown": "text", "csv": "text"}
PAGES = "document_id string, ord int, page_no int, text string, method string, failure_reason string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def kind_of(path: str, content: bytes) -> str:
    """By extension, else by the members of a ZIP archive."""
    kind = KINDS.get(path.rsplit(".", 1)[-1].lower())
    if kind:
        return kind
    try:
        names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
    except zipfile.BadZipFile:
        return "other"
    return "word" if "word/document.xml" in names else "ppt" if "ppt/presentation.xml" in names else "other"


def _word(content: bytes) -> list[tuple]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    parts = [said(p) for p in body.findall(f"{_W}p")]
    parts += [" | ".join(said(c) for c in row.findall(f"{_W}tc")) for table in body.findall(f"{_W}tbl") for row in table.findall(f"{_W}tr")]
    return [(None, "\n".join(p for p in parts if p))]


def _slides(content: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        root = ElementTree.fromstring(z.read(name))
        text = "\n".join(x for p in root.iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()))
        if text:
            out.append((number(name), text))
    return out


def parsed(path: str, content: bytes) -> list[tuple]:
    """``(ord, page_no, text, method, failure)`` of one file."""
    kind = kind_of(path, content)
    try:
        if kind == "text":
            return [(0, 1, content.decode("utf-8", "ignore"), "text", None)]
        if kind in ("word", "ppt"):
            return [(i, no, text, kind, None) for i, (no, text) in enumerate((_word if kind == "word" else _slides)(content))]
    except Exception as e:  # a damaged file is a row, not a failed job
        return [(0, None, "", kind, f"{type(e).__name__}: {e}")]
    return [(0, None, "", kind, "no reader for this kind of file")]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all files below a path: text, Markdown and CSV as one page, Word as one page, slides as pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in parsed(p, bytes(c))]
            out = pd.DataFrame(rows, columns=["document_id", "ord", "page_no", "text", "method", "failure_reason"])
            yield out.astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def fragments_file(spark: SparkSession, path: str) -> DataFrame:
    """Each non-blank line of a text file is a fragment."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def new_only(incoming: DataFrame, known: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that are not indexed yet."""
    return incoming.join(known.select(key), key, "left_anti")

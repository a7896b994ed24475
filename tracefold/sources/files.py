"""Files as DataFrames: served folders, manifests, exports, native documents and paginated text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import names
from tracefold.operators import fidelity, manifest as manifests

DOCUMENT = "filename STRING, document_id STRING, page_offset INT, description STRING, source_url STRING, filing_party STRING, item_type STRING"
SET = f"set_id STRING, status STRING, retrieval_eligible BOOLEAN, selection_note STRING, documents ARRAY<STRUCT<{DOCUMENT.replace(' STRING', ': STRING').replace(' INT', ': INT')}>>"
ITEM = f"control_number STRING, item_number INT, filing_date STRING, filing_party STRING, filing_description STRING, item_type STRING, selection_note STRING, sets ARRAY<STRUCT<{re.sub(r'(?m)(^|, )(set_id|status|retrieval_eligible|selection_note|documents) ', r'\1\2: ', SET)}>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def served_folder(spark: SparkSession, folder: str, control_number: str, manifest: DataFrame | None = None) -> DataFrame:
    """Served PDFs of one control number with the manifest's word on them; other names are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "length")
    files = files.select("path", "length", names.parse_filename(F.col("path")).alias("n"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"))
    files = files.where((F.col("n.control_number") == control_number)).select("path", "length", "filename", "n.*")
    if manifest is None:
        return files.withColumn("page_offset", F.lit(0)).withColumn("retrieval_eligible", F.lit(False))
    said = manifest.select("filename", *(c for c in manifest.columns if c not in ("filename", "control_number", "item_number", "document_id")))
    return manifests.with_manifest(files, said)


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, sha256) of all files that are not empty; Spark skips those that are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content", names.content_hash(F.col("content")).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Document rows of a nested or a flat manifest; of several entries of a file name the last counts. Malformed JSON raises, so that it isn't overwritten."""
    items, flat = _manifest(spark, path)
    flat = manifests.last_wins(flat.where("filename IS NOT NULL"), "filename", "_i")
    return manifests.flatten(items).unionByName(flat, allowMissingColumns=True)


def _manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The items of a nested manifest, and the entries of a flat one, with their places ``_i``; one of them is empty."""
    raw = spark.read.text(path, wholetext=True).withColumn("flat", F.trim("value", F.lit(" \t\r\n")).startswith("["))
    # Only what has the form is parsed: a filter alone would not keep the other form from the parser.
    parsed = lambda kind, own: F.from_json(F.when(own, F.col("value")), kind, {"mode": "FAILFAST"})
    items = raw.select(parsed(f"STRUCT<items: ARRAY<STRUCT<{_struct(ITEM)}>>>", ~F.col("flat")).alias("m")).select(F.posexplode("m.items").alias("_i", "x")).select("_i", "x.*")
    entries = raw.select(F.posexplode(parsed(f"ARRAY<STRUCT<{_struct(DOCUMENT)}, {_struct(SET.rsplit(', documents', 1)[0])}>>", F.col("flat"))).alias("_i", "x")).select("_i", "x.*")
    return items, entries


def _struct(ddl: str) -> str:
    """Top-level columns of a DDL string as fields of a struct."""
    out, depth, field = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            field = ""
        else:
            field += ch
    return ", ".join(out)


def read_prior(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """What an earlier manifest says of sets and of files, None if there is none; a broken one raises."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    items, flat = _manifest(spark, path)
    own = manifests.last_wins(flat.where("filename IS NOT NULL"), "filename", "_i").select("filename", *manifests.KEPT_DOC_FIELDS)
    return manifests.prior_sets(items), manifests.prior_documents(items).unionByName(own)


class DocumentSource(Protocol):
    """Where documents come from: what there is of a control number, and the bytes of it."""

    def list_documents(self, control_number: str) -> DataFrame: ...

    def fetch(self, documents: DataFrame) -> DataFrame: ...


class FolderSource:
    """The source of files in one folder, described by its ``manifest.json`` if there is one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def list_documents(self, control_number: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest.json")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return served_folder(self.spark, self.folder, control_number, read_manifest(self.spark, f"{self.folder}/manifest.json") if there else None)

    def fetch(self, documents: DataFrame) -> DataFrame:
        """(path, content, sha256) of the listed documents."""
        return contents(self.spark, self.folder, "*.[pP][dD][fF]").join(documents.select("path"), "path", "left_semi")


def read_export(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV export with all columns as text; missing required columns raise."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if lacking := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks columns {lacking}")
    return df


def paginated_text(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(doc_id, page_no, text) of text files with form feeds between pages. The stand-in for PDF extraction, for which no library is at hand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    pages = text.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\f$", ""), "\f")).alias("p", "text"))
    return pages.select("doc_id", (F.col("p") + 1).alias("page_no"), "text")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_rows(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Paragraphs outside of tables, and the rows of all tables with merged cells once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else t.text or "" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
    paragraphs = [text(p) for p in body if p.tag == f"{_W}p"]
    rows = []
    for row in (r for t in body if t.tag == f"{_W}tbl" for r in t.iter(f"{_W}tr")):
        cells = ["\n".join(text(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")]
        rows.append([c for i, c in enumerate(cells) if not i or c != cells[i - 1]])
    return paragraphs, rows


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cached values of all sheets in order, blank rows dropped, gaps filled with empty cells."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = links[sheet.get(f"{_R}id")]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in ElementTree.fromstring(book.read(part)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (max(at, len(cells) + 1) - 1 - len(cells))
                value = c.find(f"{_S}v")
                raw = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else {"1": "True", "0": "False"}.get(raw, raw) if c.get("t") == "b" else raw)
            if any(x.strip() for x in cells):
                out.append(cells)
    return out


NATIVE = "path STRING, kind STRING, text STRING, grid ARRAY<ARRAY<STRING>>, error STRING"


def read_natives(files: DataFrame) -> DataFrame:
    """(path, kind, text, grid, error) of (path, content): docx and xlsx by their XML. What can't be read has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    if kind in ("xlsx", "xlsm"):
                        grid = xlsx_rows(data)
                        rows.append((path, "xlsx", "\n".join("\t".join(r) for r in grid), grid, None))
                    elif kind == "docx":
                        paragraphs, grid = docx_rows(data)
                        rows.append((path, "docx", "\n".join([*paragraphs, *(c for r in grid for c in r)]), grid, None))
                    elif kind == "txt":
                        rows.append((path, "txt", data.decode("utf-8"), [], None))
                    else:
                        rows.append((path, kind, None, [], "no reader for this format"))
                except Exception as e:  # noqa: BLE001 - an unreadable file is a finding, not a failure of the job
                    rows.append((path, kind, None, [], type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "grid", "error"])

    return files.select("path", "content").mapInPandas(run, NATIVE)


def native_pairs(natives: DataFrame) -> DataFrame:
    """(path, label, token) of all rows of all grids."""
    return fidelity.row_pairs(natives.select("path", F.explode("grid").alias("cells")), "path")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes results as json, csv or parquet, in place of what was there."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


__all__ = ["DocumentSource", "FolderSource", "contents", "docx_rows", "native_pairs", "paginated_text", "read_export", "read_manifest", "read_natives", "read_prior", "served_folder", "table", "write_report", "xlsx_rows"]

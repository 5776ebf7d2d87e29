"""Readers: files of a folder become rows of sections; each file stands or falls by itself."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "path string, order int, kind string, section_path array<string>, text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Data rows of a worksheet that make one section.
SHEET_ROWS = 5000


def image_format(content: Column) -> Column:
    """Format of an image by its first bytes; png where they tell nothing."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("47494638"), "gif")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .otherwise("png")
    )


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the .txt and .md files below a folder; blank files give no row."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.col("value").alias("text")).filter(F.trim("text") != "")


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows of a JSON-lines file; blank lines and ``//`` comments are skipped, bad JSON fails the read."""
    schema = "query string, bucket string, kind string, file string, anchor string, also_files array<string>, expect string"
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '//')")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def docx_sections(data: bytes) -> list[tuple[str, list[str], str]]:
    """(kind, heading path, text) of the paragraphs and tables of a document, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    levels: dict[int, str] = {}
    out: list[tuple[str, list[str], str]] = []

    def text_of(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            text = text_of(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = int(name[-1]) if name[:7].lower() == "heading" and name[-1:].isdigit() else 0
            if level and text:
                levels = {k: v for k, v in levels.items() if k < level} | {level: text}
            elif text:
                out.append(("text", [levels[k] for k in sorted(levels)], text))
        elif node.tag == f"{_W}tbl":
            rows = [[text_of(c).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            rows = ["| " + " | ".join(r) + " |" for r in rows if any(r)]
            if rows:
                rule = "|" + "---|" * rows[0].count(" | ") + "---|"
                out.append(("table", [levels[k] for k in sorted(levels)], "\n".join([rows[0], rule, *rows[1:]])))
    return out


def xlsx_sections(data: bytes, most: int = SHEET_ROWS) -> list[tuple[str, list[str], str]]:
    """(kind, [sheet, rows], table) of every sheet: stored values, blank rows and trailing blank cells left out, every row as
    wide as the widest. Sheets of more than ``most`` data rows give several tables, each under the header. ``rows``
    names the first and last row of a table as the sheet numbers them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = [s.get("name") or "" for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")]
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        out = []
        for title, name in zip(titles, sheets, strict=False):
            rows: list[tuple[int, list[str]]] = []
            for nth, r in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_X}row"), 1):
                cells: list[str] = []
                for c in r.iter(f"{_X}c"):
                    col = 0
                    for ch in "".join(x for x in c.get("r") or "" if x.isalpha()):
                        col = col * 26 + ord(ch) - 64
                    v, t = c.find(f"{_X}v"), c.get("t")
                    text = "".join(x.text or "" for x in c.iter(f"{_X}t")) if t == "inlineStr" else (v.text or "" if v is not None else "")
                    text = shared[int(text)] if t == "s" and text else text
                    text = str(int(float(text))) if t in (None, "n") and text and float(text).is_integer() else text
                    cells += [""] * (max(col, len(cells) + 1) - len(cells))
                    cells[-1] = " ".join(text.split())
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    rows.append((int(r.get("r") or nth), cells))
            if rows:
                width = max(len(r) for _, r in rows)
                head, *lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for _, r in rows]
                for first in range(0, max(1, len(lines)), most):
                    part, numbers = lines[first : first + most], [n for n, _ in rows[1:]][first : first + most]
                    where = [title, f"{numbers[0]}-{numbers[-1]}"] if numbers else [title]
                    out.append(("table", where, "\n".join([head, "|" + "---|" * width, *part])))
    return out


READERS: dict[str, Callable[[bytes], list]] = {"docx": docx_sections, "xlsx": xlsx_sections, "xlsm": xlsx_sections}


def read_office(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of the .docx, .xlsx and .xlsm files below a folder.

    A file that cannot be read gives one row with its ``error`` (at most 2000 characters) and no text; other
    files are not affected. Readers run where the bytes are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx,xlsm}").load(folder).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = READERS[path.rsplit(".", 1)[-1].lower()](content)
                    rows += [(path, i, k, p, t, None) for i, (k, p, t) in enumerate(found)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, None, None, None, f"{type(e).__name__}: {e}"[:2000]))
            yield pd.DataFrame(rows, columns=["path", "order", "kind", "section_path", "text", "error"])

    return files.mapInPandas(run, SECTION)

"""JSON of unknown encoding, presentations, spreadsheets' matrices and page diagnostics, from files as `binaryFile` reads them."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-16", "utf-16-le", "utf-16-be")
CONTAINERS = ("videos", "queue", "items")
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Bytes of an archive's member that are read at most; beyond, the file is a bomb and an error.
MOST_MEMBER = 256_000_000


def decoded(content: bytes):
    """The JSON value of bytes in the first encoding that fits; None if none does."""
    for encoding in ENCODINGS:
        try:
            return json.loads(content.decode(encoding))
        except (UnicodeError, ValueError):
            continue
    return None


def unwrapped(value) -> list:
    """Items of a list, or of the first container of that name that is one; a lone object is one item."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return next((value[k] for k in CONTAINERS if isinstance(value.get(k), list)), [value])
    return []


def json_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, pos, item) of JSON files, one row an item; files that are no JSON have one row with a null item."""

    @F.pandas_udf("array<string>")
    def items(content: pd.Series) -> pd.Series:
        return content.map(lambda x: [json.dumps(y, ensure_ascii=False) for y in unwrapped(decoded(x))])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.posexplode_outer(items("content")).alias("pos", "json")).select("path", "pos", F.from_json("json", schema).alias("item"))


def member(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MOST_MEMBER:
        raise ValueError(f"{name} is too large")
    return archive.read(name)


def relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Id: (type, path in the archive) of a part's relations."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in archive.namelist():
        return {}
    found = ElementTree.fromstring(member(archive, name))
    return {x.get("Id"): (x.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(posixpath.dirname(part), x.get("Target", "")))) for x in found}


def paragraphs(xml: bytes) -> list[str]:
    rows = ("".join(t.text or "" for t in p.iter(f"{DRAWING}t")).strip() for p in ElementTree.fromstring(xml).iter(f"{DRAWING}p"))
    return [x for x in rows if x]


def slides(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = sorted((x for x in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=lambda x: int(re.findall(r"\d+", x)[-1]))
        out = []
        for k, part in enumerate(parts, 1):
            xml, links = member(archive, part), relations(archive, part)
            blocks = paragraphs(xml)
            used = [x.get(f"{RELATION}embed") or x.get(f"{RELATION}link") for x in ElementTree.fromstring(xml).iter(f"{DRAWING}blip")]
            notes = [p for kind, path in links.values() if kind == "notesSlide" and path in archive.namelist() for p in paragraphs(member(archive, path))]
            out.append({"slide": k, "title": (blocks or [""])[0][:80], "blocks": blocks, "media": [links[x][1] for x in used if x in links], "notes": "\n".join(notes)})
        return out


def media(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [{"name": x.filename, "bytes": x.file_size, "ext": posixpath.splitext(x.filename)[1].lower()} for x in archive.infolist() if x.filename.startswith("ppt/media/")]


def matrix(content: bytes) -> list[dict]:
    """Cells of a workbook's sheets: a matrix that a roster's header is looked for in."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = ["".join(t.text or "" for t in x.iter(f"{SHEET}t")) for x in ElementTree.fromstring(member(archive, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = relations(archive, "xl/workbook.xml")
        out = []
        for sheet in ElementTree.fromstring(member(archive, "xl/workbook.xml")).iter(f"{SHEET}sheet"):
            _, part = links[sheet.get(f"{RELATION}id")]
            for cell in ElementTree.fromstring(member(archive, part)).iter(f"{SHEET}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value = cell.find(f"{SHEET}v")
                if cell.get("t") == "s" and value is not None:
                    text = shared[int(value.text)]
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                else:
                    text = value.text if value is not None else None
                if text:
                    out.append({"sheet": sheet.get("name"), "row": int(row) - 1, "col": column - 1, "value": text})
        return out


def opened(files: DataFrame, read, schema: str) -> DataFrame:
    """(path, fields.., error) of files (path, content): a row for each of what read finds in one; a file that it cannot open has
    one row with the error."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [{"path": path, **x, "error": None} for x in read(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as error:
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"})
            made = pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)
            yield made.where(made.notna(), None)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def presentation_slides(files: DataFrame) -> DataFrame:
    return opened(files, slides, "slide int, title string, blocks array<string>, media array<string>, notes string")


def presentation_media(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by file and extension, the 20 largest of all)."""
    rows = opened(files, media, "name string, bytes long, ext string").where("error is null").drop("error")
    return rows.groupBy("path", "ext").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), rows.orderBy(F.desc("bytes"), "path", "name").limit(20)


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, col, value, error) of XLSX workbooks. Older binary workbooks need their own application and are an error."""
    return opened(files, matrix, "sheet string, row int, col int, value string")

"""Office files: a file becomes rows of paragraphs and cells, which column operations turn into blocks.

Python only opens the archive of one file and reads its markup; sections, slides and sheets are
assembled by Spark.  A file that cannot be read gives one row with role `error`; an empty one
gives none.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ELEMENTS = "path string, part int, place int, role string, level int, row int, col int, text string"
COLUMNS = ["path", "part", "place", "role", "level", "row", "col", "text"]
_ARROW = pa.schema([(c, pa.string() if c in ("path", "role", "text") else pa.int32()) for c in COLUMNS])

# Fixed values of the file formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAIN = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}

Element = tuple[int, str, int, int, int, str]  # part, role, level, row, column, text


def targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id -> member of the archive, for one part of the package."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in book.namelist():
        return {}
    found = ElementTree.fromstring(book.read(rels))
    return {x.get("Id"): posixpath.normpath(posixpath.join(folder, x.get("Target"))) if not x.get("Target", "").startswith("/") else x.get("Target")[1:] for x in found}


def heading_level(style: str) -> int:
    """Level of a paragraph style, 0 if it is no heading."""
    style = style.strip().lower()
    if style == "title":
        return 1
    digits = "".join(c for c in style if c.isdigit())
    return 0 if not style.startswith("heading") else min(int(digits), 6) if digits else 1


def _said(node: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter(tag))


def docx(book: zipfile.ZipFile) -> Iterator[Element]:
    """Paragraphs in order; a table's cells follow at its place, numbered by table."""
    body = ElementTree.fromstring(book.read(MAIN["docx"])).find(f"{_W}body")
    tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            text = _said(node, f"{_W}t").strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = heading_level(style.get(f"{_W}val", "")) if style is not None else 0
            if text:
                yield 0, "heading" if level else "text", level, 0, 0, text
        elif node.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(node.iter(f"{_W}tr")):
                for c, cell in enumerate(row.iter(f"{_W}tc")):
                    yield tables, "cell", 0, r, c, "\n".join(_said(p, f"{_W}t") for p in cell.iter(f"{_W}p"))


def pptx(book: zipfile.ZipFile) -> Iterator[Element]:
    """Slides in the order of the presentation: title, bullets with their level, cells, notes."""
    deck, names = ElementTree.fromstring(book.read(MAIN["pptx"])), targets(book, MAIN["pptx"])
    for n, ref in enumerate(deck.iter(f"{_P}sldId"), 1):
        member = names[ref.get(f"{_R}id")]
        slide, title = ElementTree.fromstring(book.read(member)), ""
        bullets: list[Element] = []
        for shape in slide.iter(f"{_P}sp"):
            kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            lines = [(p.find(f"{_A}pPr"), _said(p, f"{_A}t").strip()) for p in shape.iter(f"{_A}p")]
            if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                title = "\n".join(t for _, t in lines).strip()
            else:
                bullets += [(n, "text", int(mark.get("lvl", 0)) if mark is not None else 0, 0, 0, t) for mark, t in lines if t]
        yield n, "title", 0, 0, 0, title
        yield from bullets
        for r, row in enumerate(slide.iter(f"{_A}tr")):
            for c, cell in enumerate(row.iter(f"{_A}tc")):
                yield n, "cell", 0, r, c, _said(cell, f"{_A}t")
        for notes in (x for x in targets(book, member).values() if "notesSlide" in x):
            page = ElementTree.fromstring(book.read(notes))
            bodies = [s for s in page.iter(f"{_P}sp") if (k := s.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")) is not None and k.get("type") == "body"]
            said = "\n".join(_said(p, f"{_A}t") for s in bodies for p in s.iter(f"{_A}p")).strip()
            if said:
                yield n, "notes", 0, 0, 0, said


def _column(ref: str) -> int:
    """Column number of a cell's reference, from 0."""
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx(book: zipfile.ZipFile) -> Iterator[Element]:
    """Sheets in order: the name, then every filled cell (stored values, no formulas)."""
    work, names = ElementTree.fromstring(book.read(MAIN["xlsx"])), targets(book, MAIN["xlsx"])
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_said(x, f"{_S}t") for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    for n, sheet in enumerate(work.iter(f"{_S}sheet"), 1):
        yield n, "sheet", 0, 0, 0, sheet.get("name", "")
        for r, row in enumerate(ElementTree.fromstring(book.read(names[sheet.get(f"{_R}id")])).iter(f"{_S}row")):
            for c, cell in enumerate(row.iter(f"{_S}c")):
                kind, value = cell.get("t", "n"), cell.find(f"{_S}v")
                text = _said(cell, f"{_S}t") if kind == "inlineStr" else (value.text or "") if value is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                if text:
                    ref = cell.get("r")
                    yield n, "cell", 0, int(row.get("r", r + 1)) - 1, _column(ref) if ref else c, text


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx}


def elements(files: DataFrame, most: int = 4 << 20) -> DataFrame:
    """Rows of ELEMENTS from files (path, content binary), handed on after some `most` characters; the format is told by the archive's main part."""

    def of(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
                form = next((k for k, main in MAIN.items() if main in book.namelist()), None)
                if form is None:
                    raise ValueError("no office document")
                for place, (part, role, level, row, col, text) in enumerate(READERS[form](book)):
                    yield path, part, place, role, level, row, col, text
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
            yield path, -1, -1, "error", 0, 0, 0, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                for x in of(path.as_py(), content.as_py()):
                    held.append(dict(zip(COLUMNS, x, strict=True)))
                    size += len(x[-1]) + 100
                    if size >= most:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, ELEMENTS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all office files below a path."""
    return elements(spark.read.format("binaryFile").load(path))


def sections(found: DataFrame) -> DataFrame:
    """path, part, section, text of text documents: paragraphs under their heading, blank lines between.

    A heading with nothing below it is dropped unless the document has no other section.
    """
    w = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    p = found.where(F.col("role").isin("heading", "text")).withColumn("part", F.sum((F.col("role") == "heading").cast("int")).over(w))
    line = F.when(F.col("role") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    g = p.groupBy("path", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"),
        F.substring(F.max(F.when(F.col("role") == "heading", F.col("text"))), 1, 200).alias("section"), F.max(F.col("role") == "text").alias("filled"),
    )
    return g.withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("filled or n = 1").select("path", "part", "section", "text")


def slides(found: DataFrame) -> DataFrame:
    """path, page, section, text of presentations: numbered title, bullets indented by level, table rows, notes."""
    rows = found.where("role = 'cell'").groupBy("path", "part", "row").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("col", "text"))).alias("cells"))
    rows = rows.select("path", "part", "place", F.lit("row").alias("role"), F.lit(0).alias("level"), F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda x: x["text"]), " | "), F.lit(" |")).alias("text"))
    given = found.where(F.col("role").isin("title", "text", "notes")).select("path", "part", "place", "role", "level", "text").unionByName(rows)
    head = F.concat(F.lit("# Slide "), F.col("part").cast("string"), F.when(F.col("text") != "", F.concat(F.lit(": "), F.col("text"))).otherwise(""))
    line = F.when(F.col("role") == "title", head).when(F.col("role") == "text", F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), F.col("text"))).when(F.col("role") == "notes", F.concat(F.lit("Speaker notes: "), F.col("text"))).otherwise(F.col("text"))
    title = F.max(F.when((F.col("role") == "title") & (F.col("text") != ""), F.col("text")))
    g = given.groupBy("path", F.col("part").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), title.alias("title"))
    return g.select("path", "page", F.coalesce("title", F.concat(F.lit("Slide "), F.col("page").cast("string"))).alias("section"), "text")


def records(found: DataFrame) -> DataFrame:
    """path, sheet, row, cells (map of column number to text) of workbooks and tables; rows without a filled cell are left out."""
    cells = found.where("role = 'cell' and trim(text) <> ''").groupBy("path", F.col("part").alias("sheet"), "row")
    return cells.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "text")))).alias("cells"))

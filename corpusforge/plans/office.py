"""Queries over office files: every document is packed as a file of each format and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources import office as O
from ..sources.readers import table

# Fixed values of the file formats.
_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def pack_docx(title: str, lines: list[str]) -> bytes:
    """The title as a heading, a line a paragraph."""
    p = [f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p>'] + [f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines]
    return archive({O.MAIN["docx"]: f"<w:document {_NS}><w:body>{''.join(p)}</w:body></w:document>"})


def pack_pptx(title: str, lines: list[str], size: int = 5) -> bytes:
    """Slides of five lines, every second one indented; the title stands on the first slide only."""
    parts = [lines[i : i + size] for i in range(0, len(lines), size)] or [[]]
    out = {O.MAIN["pptx"]: f"<p:presentation {_NS}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + i}" r:id="s{i}"/>' for i in range(len(parts))) + "</p:sldIdLst></p:presentation>"}
    out["ppt/_rels/presentation.xml.rels"] = f"<Relationships {_RELS}>" + "".join(f'<Relationship Id="s{i}" Target="slides/slide{i + 1}.xml"/>' for i in range(len(parts))) + "</Relationships>"
    for i, part in enumerate(parts):
        head = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(title) if not i else ""}</a:t></a:r></a:p></p:txBody></p:sp>'
        body = "".join(f'<a:p><a:pPr lvl="{k % 2}"/><a:r><a:t>{escape(x)}</a:t></a:r></a:p>' for k, x in enumerate(part))
        out[f"ppt/slides/slide{i + 1}.xml"] = f"<p:sld {_NS}><p:cSld><p:spTree>{head}<p:sp><p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return archive(out)


def pack_xlsx(title: str, lines: list[str]) -> bytes:
    """One sheet: the line's number, its length and its text in the columns A, C and D."""
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="C{i}"><v>{len(x)}</v></c><c r="D{i}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c></row>' for i, x in enumerate(lines, 1))
    return archive({
        O.MAIN["xlsx"]: f'<workbook {_SHEET}><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {_RELS}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{rows}</sheetData></worksheet>",
    })


def files(spark, d, pack: Callable[[str, list[str]], bytes]) -> DataFrame:
    """path (the doc_id), content: documents as files; a null text has no lines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"path": p["doc_id"].astype(str), "content": [pack(s or "", [] if t is None else t.split("\n")) for s, t in zip(p["source"], p["text"], strict=True)]})

    return table(spark, d, "documents").select("doc_id", "source", "text").mapInPandas(run, "path string, content binary")


# Blanks that both sides trim from a line.
_TRIM = r"regexp_replace(x, '^[\s\x{0085}\x{00A0}\x{2028}\x{2029}]+|[\s\x{0085}\x{00A0}\x{2028}\x{2029}]+$', '', 'g')"
_LINES = f"l AS (SELECT doc_id, source, n, {_TRIM} AS t FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))"


@query("office_docx", f"WITH {_LINES} SELECT doc_id, source AS section, md5('## ' || source || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY n)) AS text_md5 FROM l WHERE t <> '' GROUP BY doc_id, source UNION ALL SELECT doc_id, source, md5('## ' || source) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE t <> '')")
def office_docx(spark, d):
    """Sections of word processor files."""
    s = O.sections(O.elements(files(spark, d, pack_docx)))
    return s.select(F.col("path").cast("long").alias("doc_id"), "section", F.md5("text").alias("text_md5"))


@query("office_pptx", f"""WITH {_LINES}, s AS (SELECT doc_id, source, n // 5 + 1 AS page, string_agg(chr(10) || CASE WHEN n % 5 % 2 = 1 THEN '  ' ELSE '' END || '- ' || t, '' ORDER BY n) FILTER (t <> '') AS body FROM l GROUP BY doc_id, source, n // 5)
SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN page = 1 THEN source ELSE 'Slide ' || page END AS section, md5('# Slide ' || page || CASE WHEN page = 1 THEN ': ' || source ELSE '' END || coalesce(body, '')) AS text_md5 FROM s""")
def office_pptx(spark, d):
    """Slides of presentations."""
    s = O.slides(O.elements(files(spark, d, pack_pptx)))
    return s.select(F.col("path").cast("long").alias("doc_id"), "page", "section", F.md5("text").alias("text_md5"))


@query("office_xlsx", "SELECT doc_id, count(*) AS n_rows, CAST(sum(length(x)) AS BIGINT) AS chars, CAST(sum(n) AS BIGINT) AS numbers FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) GROUP BY doc_id")
def office_xlsx(spark, d):
    """Rows of workbooks: the cells are found by their column, empty columns included."""
    r = O.records(O.elements(files(spark, d, pack_xlsx)))
    return r.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n_rows"), F.sum(F.col("cells")[2].cast("long")).alias("chars"), F.sum(F.col("cells")[0].cast("long")).alias("numbers"))

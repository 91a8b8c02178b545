"""Office files, stored chunks, names and layout: hand-made cases."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import geometry as G
from corpusforge.operators import store
from corpusforge.plans import office as P
from corpusforge.sources import office as O
from corpusforge.session import ship, shared_folder


@pytest.fixture(scope="module")
def files(spark):
    ship(spark)

    def make(**named):
        return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in named.items()], "path string, content binary")

    return make


def test_unreadable_files_are_told(files):
    other = P.archive({"a.txt": "x"})
    broken = P.archive({O.MAIN["docx"]: "<w:document"})
    rows = {r.path: r for r in O.elements(files(none=None, blank=b"", other=other, broken=broken)).collect()}
    assert {k: r.role for k, r in rows.items()} == dict.fromkeys(("none", "blank", "other", "broken"), "error")
    assert rows["other"].text == "ValueError: no office document"


def test_docx_sections_and_tables(files):
    cell = lambda *t: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t) + "</w:tc>"
    para = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = para("Top", "Title") + para("intro", "Normal") + para("Bare", "Heading3") + para("Last", "Heading9") + para("end") + f"<w:tbl><w:tr>{cell('a', 'b')}{cell('c')}</w:tr></w:tbl>"
    book = P.archive({O.MAIN["docx"]: f"<w:document {P._NS}><w:body>{body}</w:body></w:document>"})
    found = O.elements(files(x=book))
    assert [(r.section, r.text) for r in O.sections(found).orderBy("part").collect()] == [("Top", "# Top\n\nintro"), ("Last", "###### Last\n\nend")]
    assert [r.cells for r in O.records(found).collect()] == [{0: "a\nb", 1: "c"}]
    alone = O.sections(O.elements(files(x=P.pack_docx("Only", [])))).collect()
    assert [(r.section, r.text) for r in alone] == [("Only", "## Only")]


def test_pptx_notes_and_table(files):
    row = "<a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl>"
    shape = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    book = P.archive({
        O.MAIN["pptx"]: f'<p:presentation {P._NS}><p:sldIdLst><p:sldId id="1" r:id="s"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {P._RELS}><Relationship Id="s" Target="slides/one.xml"/></Relationships>',
        "ppt/slides/one.xml": f"<p:sld {P._NS}>{shape('body', 'point')}{shape('title', 'Name')}{row}</p:sld>",
        "ppt/slides/_rels/one.xml.rels": f'<Relationships {P._RELS}><Relationship Id="n" Target="../notesSlides/n.xml"/></Relationships>',
        "ppt/notesSlides/n.xml": f"<p:notes {P._NS}>{shape('sldNum', '1')}{shape('body', 'say it')}</p:notes>",
    })
    assert [(r.page, r.section, r.text) for r in O.slides(O.elements(files(x=book))).collect()] == [(1, "Name", "# Slide 1: Name\n- point\n| k | v |\nSpeaker notes: say it")]


def test_xlsx_cell_kinds(files):
    row = '<row r="3"><c r="AB3" t="s"><v>1</v></c><c r="A3" t="b"><v>1</v></c><c r="C3"><v>2.5</v></c><c r="D3"/></row>'
    book = P.archive({
        O.MAIN["xlsx"]: f'<workbook {P._SHEET}><sheets><sheet name="S" sheetId="1" r:id="r"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {P._RELS}><Relationship Id="r" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f"<worksheet {P._SHEET}><sheetData>{row}</sheetData></worksheet>",
        "xl/sharedStrings.xml": f"<sst {P._SHEET}><si><t>no</t></si><si><r><t>ye</t></r><r><t>s</t></r></si></sst>",
    })
    got = O.records(O.elements(files(x=book))).collect()
    assert [(r.sheet, r.row, r.cells) for r in got] == [(1, 2, {0: "TRUE", 2: "2.5", 27: "yes"})]


def test_filenames(spark):
    names = ["", "/", "a/b/", "x\\y", "a**b", "é" * 150, "a" + "🙂é" * 90, "ab" * 150, None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(T.safe_filename(F.col("n"))).collect()]
    assert got[:6] == ["upload", "upload", "b", "x_y", "a_b", "é" * 100]
    assert got[6] == "a" + "_é" * 66 + "_"
    assert got[7] == "ab" * 100 and got[8] is None
    cut = spark.createDataFrame([("a🙂b",)], "t string").select(*[T.within_bytes(F.col("t"), n) for n in range(7)]).first()
    assert list(cut) == ["", "a", "a", "a", "a", "a🙂", "a🙂b"]


def test_mail_name_that_begins_with_a_dash(spark):
    got = spark.createDataFrame([(" — x",), ("a — b — c.Txt",), ("plain",)], "n string").select(T.mail_parts(F.col("n")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [(" — x", None), ("a — b", "c"), ("plain", None)]


def test_grid_or_prose(spark):
    rows = []
    for g, (left, right, shift) in {"grid": ("Ann", "12", 0.0), "prose": ("some words that run on and on", "more words that run on as well", 0.0), "apart": ("Ann", "12", 0.05)}.items():
        for i in range(4):
            rows += [(g, True, i / 10, i / 10 + 0.02, left), (g, False, i / 10 + shift, i / 10 + shift + 0.02, right)]
    rows += [("one side", True, 0.0, 0.1, "1"), ("one side", True, 0.2, 0.3, "2")]
    got = G.gutter_is_grid(spark.createDataFrame(rows, "g string, is_left boolean, y0 double, y1 double, text string"), ["g"]).collect()
    assert {r.g: r.is_grid for r in got} == {"grid": True, "prose": False, "apart": False, "one side": False}


def test_store_keeps_other_rows_of_a_bucket(spark):
    columns, folder = "doc_id long, ordinal int, version int, kb string", shared_folder(spark)
    make = lambda *rows: spark.createDataFrame(rows, columns)
    store.create(make(*[(i, 0, 1, "a b/c") for i in range(40)], (1, 0, 1, "other")), folder)
    store.replace_documents(spark, folder, make((3, 0, 2, "a b/c"), (3, 1, 2, "a b/c")), columns)
    store.insert_absent(spark, folder, make((3, 0, 9, "a b/c"), (99, 0, 9, "a b/c"), (99, 0, 9, "a b/c")), columns)
    rows = store.read(spark, folder, columns).where("kb = 'a b/c'").collect()
    assert sorted((r.doc_id, r.ordinal, r.version) for r in rows) == sorted([(i, 0, 1) for i in range(40) if i != 3] + [(3, 0, 2), (3, 1, 2), (99, 0, 9)])
    assert store.delete_kb(spark, folder, "a b/c") and not store.delete_kb(spark, folder, "a b/c")
    assert [r.doc_id for r in store.read(spark, folder, columns).collect()] == [1]

"""Office files made here come back as Markdown; damaged ones as rows with a reason."""

import io
import zipfile

from eventloom import sources
from eventloom.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def paragraph(text, style=None, listed=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if listed else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx():
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    body = paragraph("Top", "Heading1") + paragraph("a &amp; b ü 中") + paragraph("one", listed=True) + paragraph("") + paragraph("Low", "Heading3")
    body += f"<w:tbl><w:tr>{cell('x|y')}{cell('n')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl><w:sdt><w:sdtContent>{paragraph('inside')}</w:sdtContent></w:sdt>"
    body += "<w:p><w:r><w:t>l1</w:t><w:br/><w:t>l2</w:t></w:r></w:p>"
    return package(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


DOCX = "# Top\n\na & b ü 中\n\n- one\n\n### Low\n\n| x\\|y | n |\n| --- | --- |\n| 1 |  |\n\ninside\n\nl1\nl2"


def pptx():
    shape = lambda text, kind=None: f"<p:sp><p:nvSpPr><p:nvPr>{f'<p:ph type=%r/>' % kind if kind else ''}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda inner: f"<p:sld {A}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return package(**{
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="/ppt/slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": slide(shape("second")),
        "ppt/slides/slide2.xml": slide(shape("Title", "title") + shape("first")),
    })


def xlsx():
    return package(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Sums" sheetId="1" r:id="a"/><sheet name="None" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"><v>3.5</v></c><c r="C2" t="b"><v>1</v></c></row><row/><row><c r="AA4" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    })


def test_formats():
    assert office.markdown(docx(), "docx") == DOCX
    assert office.markdown(pptx(), "pptx") == "<!-- Slide 1 -->\n\n# Title\n\nfirst\n\n<!-- Slide 2 -->\n\nsecond"
    lines = office.markdown(xlsx(), "xlsx").split("\n")
    assert lines[0] == "## Sums" and lines[-1] == "## None" and len(lines) == 8
    assert [x.strip() for x in lines[2].split("|")[1:5]] == ["name", "", "rich", ""] and [x.strip() for x in lines[4].split("|")[1:4]] == ["", "3.5", "TRUE"]
    assert lines[5].split("|")[27].strip() == "far"


def test_folder(spark, tmp_path):
    files = {"a.docx": docx(), "b/B.PPTX": pptx(), "c.xlsx": xlsx(), "cut.docx": docx()[:300], "no.xlsx": b"plain", "empty.md": b" \n", "t.md": "# Ü\n\ntext".encode(), "p.html": b"<title>T</title><p>x</p>", "skip.pdf": b"%PDF", "other.bin": b"1",
             "wrong.pptx": docx(), "broken.docx": package(**{"word/document.xml": "<w:document>"})}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {n.rsplit("/", 1)[-1] for n in files} - {"skip.pdf", "other.bin"}
    assert got["a.docx"].text == DOCX and got["B.PPTX"].suffix == "pptx" and got["B.PPTX"].text.startswith("<!-- Slide 1 -->")
    assert {n for n, r in got.items() if r.text is None} == {"cut.docx", "no.xlsx", "empty.md", "wrong.pptx", "broken.docx"} == {n for n, r in got.items() if r.error}
    assert got["empty.md"].error == "empty" and got["cut.docx"].error.startswith("BadZipFile") and got["broken.docx"].error.startswith("ParseError")
    assert got["a.docx"].bytes == len(docx()) and got["p.html"].text == "# T\nx"
    assert {r.path.rsplit("/", 1)[-1] for r in sources.documents(spark, str(tmp_path)).collect()} == {n for n, r in got.items() if r.text}
    large = office.decode(spark.createDataFrame([("docx", bytearray(docx())), ("docx", None), ("odt", b"x")], "suffix string, content binary"), most=10)
    assert sorted(r.error.split(":")[0] for r in large.collect()) == ["BadZipFile", "KeyError", "ValueError"]

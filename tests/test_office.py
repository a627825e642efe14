import zipfile

from lectern.sources.office import markdown, read_docx, read_pptx, read_xlsx, xlsx_cells, xlsx_markdown

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(*pairs):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="x/{k}" Target="{t}"/>' for i, k, t in pairs) + "</Relationships>"


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_xlsx(spark, tmp_path):
    archive(
        tmp_path / "a.xlsx",
        {
            "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/s1.xml"), ("r2", "worksheet", "/xl/worksheets/s2.xml")),
            "xl/sharedStrings.xml": f"<sst {M}><si><t>a|b</t><rPh><t>no</t></rPh></si></sst>",
            "xl/styles.xml": f'<styleSheet {M}><numFmts><numFmt numFmtId="164" formatCode="yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
            "xl/worksheets/s1.xml": f'<worksheet {M}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5.0</v></c></row><row r="4"><c r="B4" s="1"><v>45000</v></c><c t="b"><v>1</v></c><c r="D4"><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="A2:B2"/></mergeCells></worksheet>',
            "xl/worksheets/_rels/s1.xml.rels": rels(("p", "pivotTable", "../pivot/p.xml")),
            "xl/pivot/p.xml": f'<pivotTableDefinition {M}><location ref="D4:E9"/></pivotTableDefinition>',
            "xl/worksheets/s2.xml": f"<worksheet {M}><sheetData/></worksheet>",
        },
    )
    raw = read_xlsx(spark, f"file://{tmp_path}")
    assert sorted((r.row, r.col, r.text) for r in xlsx_cells(raw).collect()) == [(2, 0, "a|b"), (2, 2, "5"), (4, 1, "2023-03-15"), (4, 2, "TRUE")]
    assert xlsx_markdown(raw).head().text == "# One\n\n| row | A | B | C |\n| --- | --- | --- | --- |\n| 2 | a\\|b |  | 5 |\n| 3 |  |  |  |\n| 4 |  | 2023-03-15 | TRUE |\n\nMerge: A2:B2\n\n# Empty\n\n"


def test_docx(spark, tmp_path):
    p = lambda t, props="", size="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{size}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = p("Big", size='<w:sz w:val="40"/>') + p("Part", '<w:pStyle w:val="Heading1"/>') + p("Some body text that is long enough. " * 5) + p("item", "<w:numPr/>")
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y|z</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    archive(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{body}{table}</w:body></w:document>"})
    text = markdown(read_docx(spark, f"file://{tmp_path}")).head().text
    assert text.startswith("# Big\n\n## Part\n\nSome body") and text.endswith("- item\n\n| x | y\\|z |\n| --- | --- |\n\n")


def test_pptx(spark, tmp_path):
    shape = lambda t, kind: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda inner: f"<p:sld {P}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    archive(
        tmp_path / "a.pptx",
        {
            "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="2" r:id="b"/><p:sldId id="1" r:id="a"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/s1.xml"), ("b", "slide", "slides/s2.xml")),
            "ppt/slides/s1.xml": slide(shape("Second", "title") + f"<p:grpSp>{shape('inner', 'body')}</p:grpSp>"),
            "ppt/slides/s2.xml": slide(shape("First", "title") + shape("3", "sldNum")),
            "ppt/slides/_rels/s2.xml.rels": rels(("n", "notesSlide", "../notes/n.xml")),
            "ppt/notes/n.xml": slide(shape("a note", "body")),
        },
    )
    assert markdown(read_pptx(spark, f"file://{tmp_path}")).head().text == "# First\n\n## Second\n\ninner\n\n---\n\nSECONDARY ELEMENT:\n\na note\n\n"
